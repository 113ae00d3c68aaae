"""Language ID by Bayesian evidence fusion.

For a document d and a language l the posterior is proportional to

    P(l | host) * P(text | l) ** TEXT_WEIGHT * P(declared | l) * P(suffix | l)

* text: hashed character trigrams, one multinomial per language, and "und" as a uniform one;
* declared: what the markup or metadata says (a ``lang`` attribute or column);
* suffix: the address's last host label, with a two-letter first path step if there is one;
* host: counts of text decisions per host, smoothed to its registered domain's, these to the
  whole corpus's; a document's own vote is taken out of its prior.

The channels P(declared | l) and P(suffix | l) and the host counts are grouped aggregations
over all documents.  Only the trigram tables are fitted on a sample: per declared language
at most ``TRAIN_DOCS`` different texts (lowest hashes) of ``TRAIN_CHARS`` characters; after a
first fit texts that are decided otherwise change sides, and the tables are fitted again.
Every declared language with ``MIN_TEXTS`` different texts has a table, and if none has as
many, every declared one; there is no rank cap.  Time and the tables' memory (256 KB each)
grow with the number of languages.

A document is rejected (kept = false) if its text has no letters, if "und" wins, or if the
posterior is below ``MIN_POSTERIOR``.

Defined results: null and empty texts are "und" and rejected; null or unknown declared
languages, hosts and suffixes count as no evidence (for P(declared | l) a value of its own);
repeated rows are decided alike; without any declared language short built-in word lists of
four languages stand in; an empty table gives no rows; extra columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, read_table, row_hash, small_batches, stored

BITS, PIECE = 16, 4096  # trigram slots; trigrams of a text that are summed at once
TRAIN_DOCS, TRAIN_CHARS, MIN_TEXTS = 400, 3000, 3
TEXT_WEIGHT, MIN_POSTERIOR = 0.3, 0.5
KAPPA = 20.0  # strength of the domain's prior over its hosts, and of the corpus's over its domains
UND = "und"

# fixed values: frequent words, used only where nothing is declared
SEEDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei",
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más pero sus le ya o este sí porque esta entre",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont mais comme ou son avec nous",
}

_ALPHA = np.zeros(0, bool)


def _letters() -> np.ndarray:
    """Whether a code point below 2**16 is a letter; those above count as letters."""
    global _ALPHA
    if not _ALPHA.size:
        _ALPHA = np.array([chr(c).isalpha() for c in range(1 << 16)])
    return _ALPHA


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(slot of every trigram, number of the text it is in), over lower-cased letters with
    single blanks for everything between."""
    joined = "\0".join(" " + t.lower() + " " for t in texts)
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.cumsum(c == 0)
    low = c < 1 << 16
    letter = ~low
    letter[low] = _letters()[c[low]]
    c = np.where(letter, c, np.where(c == 0, 0, 32)).astype(np.uint64)
    keep = (c != 32) | (np.diff(c, prepend=np.uint64(1)) != 0)
    c, doc = c[keep], doc[keep]
    if len(c) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x, y, z = c[:-2], c[1:-1], c[2:]
    h = (x * np.uint64(0x9E3779B97F4A7C15) + y) * np.uint64(0xD6E8FEB86659FD93) + z
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    slot = (h >> np.uint64(64 - BITS)).astype(np.int64)
    whole = (x != 0) & (y != 0) & (z != 0) & ((x != 32) | (z != 32) | (y != 32))
    return slot[whole], doc[1:-1][whole]


def text_scores(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log likelihoods per text and class, number of trigrams)."""
    out, n = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts), np.int64)
    slot, doc = trigrams(texts)
    if len(slot):
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        place = np.arange(len(slot)) - np.repeat(first, np.diff(first, append=len(slot)))
        piece = np.append(np.flatnonzero(place % PIECE == 0), len(slot))
        step = max(1, (1 << 24) // (PIECE * table.shape[1]))  # memory stays the same for any number of classes
        for lo in range(0, len(piece) - 1, step):
            at = piece[lo:lo + step + 1]
            sums = np.add.reduceat(table[slot[at[0]:at[-1]]], at[:-1] - at[0], axis=0)
            np.add.at(out, doc[at[:-1]], sums)
        n = np.bincount(doc, minlength=len(texts))
    return out, n


def fit(samples: list[tuple[str, str]]) -> tuple[list[str], np.ndarray]:
    """(languages, table of log probabilities: slot x language, "und" last).  A tag all of whose
    texts change sides has no table."""
    samples = samples or list(SEEDS.items())
    langs = sorted({lang for lang, _ in samples})
    size = 1 << BITS
    number = {lang: k for k, lang in enumerate(langs)}
    label = np.array([number[lang] for lang, _ in samples])
    texts = [t for _, t in samples]
    for turn in range(2):
        if turn:
            left = np.unique(label)
            langs, label = [langs[k] for k in left], np.searchsorted(left, label)
        table = np.zeros((size, len(langs) + 1), np.float32)
        for i in range(len(texts)):
            np.add.at(table[:, label[i]], trigrams([texts[i]])[0], 1)
        total = table.sum(axis=0, dtype=np.float64)
        for k in range(len(langs)):
            table[:, k] = np.log((table[:, k].astype(np.float64) + 0.5) / (total[k] + 0.5 * size))
        table[:, -1] = -np.log(size)
        if turn == 0 and len(langs) > 1:
            for i, text in enumerate(texts):
                score, n = text_scores([text], table[:, :-1])
                label[i] = score[0].argmax() if n[0] else label[i]
    return langs, table


def declared_language(value: Column) -> Column:
    """Primary subtag of a language tag, lower case; null if there is none."""
    tag = F.lower(F.regexp_extract(value.cast("string"), r"^\s*([A-Za-z]{2,3})\b", 1))
    return F.when(tag != "", tag)


def markup_language(html: Column) -> Column:
    """The lang attribute of the html element."""
    return declared_language(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1))


def url_host(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    return F.when(host != "", host)


def url_suffix(url: Column) -> Column:
    label = F.regexp_extract(url_host(url), r"([^.]+)\.?$", 1)
    step = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([A-Za-z]{2})(?:[/?#]|$)", 1))
    return F.when(label != "", F.concat_ws("/", label, F.when(step != "", step)))


def registered_domain(host: Column) -> Column:
    """The last two labels of a host; null for a name without a dot, whose counts would be used twice."""
    return F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)\.?$", 1), F.lit(""))


def evidence(docs: DataFrame, text: Column, declared: Column, host: Column | None = None,
             suffix: Column | None = None, keys: dict[str, Column] | None = None) -> DataFrame:
    """Plain columns (keys ..., text, declared, host, domain, suffix) for :func:`identify`."""
    nothing = F.lit(None).cast("string")
    host = nothing if host is None else host.cast("string")
    return docs.select(*[c.alias(k) for k, c in (keys or {}).items()], text.alias("text"), declared.alias("declared"),
                       host.alias("host"), registered_domain(host).alias("domain"),
                       (nothing if suffix is None else suffix).alias("suffix"))


def training_sample(rows: DataFrame) -> list[tuple[str, str]]:
    """Per declared language with ``MIN_TEXTS`` different texts, at most ``TRAIN_DOCS`` of them."""
    known = rows.where("declared IS NOT NULL AND text IS NOT NULL") \
                .select("declared", "text", row_hash(F.col("text")).alias("mark"))
    each = stored(known.select("declared", "mark").distinct().groupBy("declared").agg(F.count("*").alias("n")))
    if not each.where(F.col("n") >= MIN_TEXTS).isEmpty():
        each = each.where(F.col("n") >= MIN_TEXTS)
    cells = 1 << 30
    # hash share that holds 2 * TRAIN_DOCS different texts on average; tags of two or three letters are few
    each = each.select("declared", F.expr(f"least({cells}L, {2 * TRAIN_DOCS * cells}L div n + 1)").alias("cut"))
    part = known.join(F.broadcast(each), "declared").where(F.col("mark") % cells < F.col("cut"))
    part = part.select("declared", "mark", F.substring("text", 1, TRAIN_CHARS).alias("t")).distinct()
    place = F.row_number().over(Window.partitionBy("declared").orderBy(F.col("mark") % cells, "mark", "t"))
    part = part.withColumn("place", place).where(F.col("place") <= TRAIN_DOCS)
    return sorted((r[0], r[1]) for r in part.select("declared", "t").collect())


@small_batches
def identify(rows: DataFrame) -> DataFrame:
    """``rows`` as :func:`evidence` gives them, without the text, plus text_lang, lang_id,
    posterior and kept."""
    langs, table = fit(training_sample(rows))
    names = [*langs, UND]
    keys = [c for c in rows.columns if c != "text"]

    def score(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                s, n = text_scores([t or "" for t in part.column(0).to_pylist()], table)
                best = np.where(n > 0, s.argmax(axis=1), len(langs))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], pa.array(list(s * TEXT_WEIGHT), pa.list_(pa.float64())), pa.array(n, pa.int64()),
                     pa.array(best, pa.int32())], [*keys, "ll", "n_grams", "vote"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    scored = stored(rows.select("text", *keys).mapInArrow(score, f"{schema}, ll array<double>, n_grams bigint, vote int"))

    k = len(names)
    slots = F.sequence(F.lit(0), F.lit(k - 1))
    total = [0.0] * k
    for vote, n in scored.groupBy("vote").count().collect():
        total[vote] = float(n)
    world = np.array(total) + np.array([1.0] * (k - 1) + [0.01])
    world = F.array(*[F.lit(float(x)) for x in world / world.sum()])

    def counts(col, alias):
        """Votes per class for each value, one row a value."""
        each = scored.where(F.col(col).isNotNull()).groupBy(col, "vote").agg(F.count("*").cast("double").alias("n"))
        each = each.groupBy(col).agg(F.map_from_entries(F.collect_list(F.struct("vote", "n"))).alias("m"))
        return stored(each.select(col, F.transform(slots, lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias(alias)))

    hosts, domains = counts("host", "in_host"), counts("domain", "in_domain")
    said, tails = counts("declared", "with_declared"), counts("suffix", "with_suffix")
    out = scored
    # one row per host, domain, tag or suffix on the right: Spark broadcasts it only below its limit
    for col, right in (("host", hosts), ("domain", domains), ("declared", said), ("suffix", tails)):
        out = out.join(right, col, "left")
    zeros = F.array_repeat(F.lit(0.0), k)
    own = F.transform(slots, lambda i: (F.col("vote") == i).cast("double"))

    def smoothed(name, prior):
        """Counts without the row's own vote, over a prior of weight KAPPA."""
        mine = F.when(F.col(name).isNull(), zeros).otherwise(
            F.zip_with(F.col(name), own, lambda a, b: F.greatest(a - b, F.lit(0.0))))
        total = F.aggregate(mine, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(mine, prior, lambda a, p: (a + F.lit(KAPPA) * p) / (total + KAPPA))

    prior = smoothed("in_host", smoothed("in_domain", world))
    per_lang = F.array(*[F.lit(t) for t in total])
    tags = F.array(*[F.lit(x) for x in names])

    def channel(name, col):
        """log P(value | l) from counts over all rows; nothing where the value is null."""
        agrees = F.transform(tags, lambda x: (F.col(col) == x).cast("double"))
        seen = F.zip_with(F.coalesce(F.col(name), zeros), agrees, lambda a, g: a + 0.5 + 2 * g)
        return F.when(F.col(col).isNull(), zeros).otherwise(
            F.zip_with(seen, per_lang, lambda a, n: F.log(a / (n + 4.0))))

    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    log_post = add(add(F.col("ll"), F.transform(prior, lambda p: F.log(F.greatest(p, F.lit(1e-9))))),
                   add(channel("with_declared", "declared"), channel("with_suffix", "suffix")))
    out = out.withColumn("_post", log_post).withColumn("_top", F.array_max("_post"))
    mass = F.aggregate("_post", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_top")))
    best = F.element_at(tags, F.array_position("_post", F.col("_top")).cast("int"))
    best = F.when(F.col("n_grams") == 0, F.lit(UND)).otherwise(best)
    return out.select(*keys, F.element_at(tags, F.col("vote") + 1).alias("text_lang"), best.alias("lang_id"),
                      (1.0 / mass).alias("posterior"),
                      ((best != UND) & (1.0 / mass >= MIN_POSTERIOR)).alias("kept"))


def document_evidence(docs: DataFrame, **keys: Column) -> DataFrame:
    """Evidence of ``documents``: the declared language is ``lang``, the source stands for the host.
    The table has no address, so there is no suffix, and a domain only where a source has a dot."""
    return evidence(docs, F.col("text"), declared_language(F.col("lang")), F.col("source"), keys=keys)


def page_evidence(pages: DataFrame, **keys: Column) -> DataFrame:
    """Evidence of ``pages``: text without tags, the html element's language, host and suffix."""
    body = F.regexp_replace(F.col("html"), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*+>", " ")
    return evidence(pages, body, markup_language(F.col("html")), url_host(F.col("url")), url_suffix(F.col("url")), keys=keys)


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is identified."""
    mark, key = F.xxhash64("text", "lang", "source"), F.col("doc_id")
    m, k = free_name(docs, "_mark"), free_name(docs, "_key")
    rejected = identify(document_evidence(docs, **{m: mark, k: key})).where("NOT kept").select(m, k).distinct()
    return docs.join(rejected, (mark == F.col(m)) & key.eqNullSafe(F.col(k)), "left_anti")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return identify(document_evidence(docs, doc_id=F.col("doc_id"))).select(
        "doc_id", F.col("declared").alias("declared_lang"), "text_lang", "lang_id", F.round("posterior", 6).alias("posterior"), "kept")


def pages_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fusion over ``pages``, where markup, address and host all speak."""
    pages = read_table(spark, sf_dir, "pages")
    return identify(page_evidence(pages, page_id=F.col("page_id"))).select(
        "page_id", F.col("declared").alias("declared_lang"), "text_lang", "lang_id", F.round("posterior", 6).alias("posterior"), "kept")
