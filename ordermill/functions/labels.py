"""Fixed values that must equal the reference's for identical results."""

from __future__ import annotations

# --- fixed values: weekday order of the heatmap rows ---------------------------------
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

# --- fixed values: seller health tiers (score >= cut, checked top-down; else last) ---
TIER_CUTS = (75, 55, 35)
TIER_LABELS = ("Elite", "Good", "Average", "At Risk")

# --- fixed values: RFM segment names, in rule order --------------------------------
SEGMENTS = ("Champions", "Loyal", "Potential Loyalists", "New Customers", "At Risk", "Lost")

# --- fixed values: late-rate severity bands (percent, strictly greater) -------------
SEVERITY_BANDS = (10, 15)
SEVERITY_LABELS = ("low", "medium", "high")

# --- fixed values: delivery status labels of the timeliness query -------------------
LATE_LABEL = "Late"
ON_TIME_LABEL = "On Time"
