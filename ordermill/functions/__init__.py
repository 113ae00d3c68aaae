"""Column helpers shared by all operators (native expressions only)."""

from ordermill.functions.exact import (cents, div_floor, half_up_div, money_avg, ratio_round,
                                       to_double)
from ordermill.functions.time import (floor_days, hours_between, is_late, month_label,
                                      week_start, weekday_name)

__all__ = ["cents", "div_floor", "half_up_div", "money_avg", "ratio_round", "to_double",
           "floor_days", "hours_between", "is_late", "month_label", "week_start", "weekday_name"]
