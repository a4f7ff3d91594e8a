"""Secrets in texts: sure spans by pattern, and weak ones reported only beside their counterpart.

Parts of a credential have a role: ``id`` (access identifiers), ``secret`` or ``endpoint``. A weak candidate is reported when a
part of a complementary role lies within ``scope`` code points: identifiers need a secret, endpoints need a secret, secrets need
an identifier or an endpoint. The interval join goes by cells of ``scope`` code points. A counterpart stands in all cells it can
reach, a weak part in those of its start and of its stop: counterparts after it are measured from the stop, those before it from
the start. A cell holds a bounded number of parts whatever the text; there is no comparison of all parts of a text.

Only DataFrame functions are used. Positions are counted in code points, ends are exclusive.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from finality.llm.shared import row_key, stored

#: Fixed patterns, by kind in the order in which kinds are listed.
ASSIGN = "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{32,}"
#: Weak parts: capitals with digits, long base-64 text, web and network addresses.
WEAK_ID = "(?<![A-Za-z0-9])[A-Z0-9]{16,32}(?![A-Za-z0-9])"
WEAK_SECRET = "(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,88}={0,2}(?![A-Za-z0-9+/=])"
ENDPOINT = "https?://[^\\s\"'<>]+|(?<![0-9.])[0-9]{1,3}(?:[.][0-9]{1,3}){3}(?![0-9.])"
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
ROLES = {"assign": "secret", "access": "id", "hex": "secret", "weak_id": "id", "weak_secret": "secret", "endpoint": "endpoint"}
NEEDS = {"weak_id": ("secret",), "weak_secret": ("id", "endpoint"), "endpoint": ("secret",)}
SPAN = "array<struct<start:int,stop:int,rank:int>>"


def spans(text: Column, pattern: str, rank: int, least: int = 0, group: int = 0) -> Column:
    """All leftmost matches that don't overlap, as (start, stop, rank), where ``group`` has ``least`` characters or more.

    A match lies between two pieces of the text split at the matches, so lengths alone give the places.
    """
    found = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part")
    )

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        stop = start + F.coalesce(F.length(x["match"]), F.lit(0))
        one = F.array(F.struct(start.alias("start"), stop.alias("stop"), F.lit(rank).alias("rank"))).cast(SPAN)
        kept = F.when(F.coalesce(F.length(x["part"]) >= least, F.lit(False)), F.concat(state["out"], one)).otherwise(state["out"])
        return F.struct(stop.alias("at"), kept.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
    return F.aggregate(found, start, step, lambda state: state["out"])


def parts_of(text: str) -> tuple[Column, Column]:
    """Sure and weak spans of a text. Cheap searches come first: most texts have no candidate of a kind."""
    value = F.coalesce(F.col(text), F.lit(""))
    lowered = F.lower(value)
    named = reduce(lambda a, b: a | b, [lowered.contains(w) for w in ("password", "passwd", "secret", "token", "apikey", "api_key")])
    none = F.array().cast(SPAN)
    sure = F.concat(
        F.when(named, spans(value, ASSIGN, 0, 8, 2)).otherwise(none),
        F.when(value.contains("AKIA"), spans(value, ACCESS, 1, 16)).otherwise(none),
        F.when(value.rlike("[0-9a-f]{32}"), spans(value, HEX, 2)).otherwise(none),
    )
    weak = F.concat(
        F.when(value.rlike("[A-Z0-9]{16}"), spans(value, WEAK_ID, 3)).otherwise(none),
        F.when(value.rlike("[A-Za-z0-9+/]{40}"), spans(value, WEAK_SECRET, 4)).otherwise(none),
        F.when(value.contains("://") | value.rlike("[0-9][.][0-9]{1,3}[.][0-9]{1,3}[.]"), spans(value, ENDPOINT, 5)).otherwise(none),
    )
    return sure, weak


def linked(found: DataFrame, scope: int) -> DataFrame:
    """(row_a, row_b, linked) of the weak spans in ``found`` (row_a, row_b, sure, weak) with a counterpart in reach."""
    # a text with one part only has nothing to link
    rows = found.filter((F.size("weak") > 0) & (F.size("weak") + F.size("sure") > 1)).dropDuplicates(["row_a", "row_b"])
    parts = rows.select("row_a", "row_b", F.explode(F.concat("sure", "weak")).alias("p")).select("row_a", "row_b", "p.*")
    role = F.element_at(F.array(*[F.lit(ROLES[k]) for k in KINDS]), F.col("rank") + 1)
    other = parts.select(
        "row_a", "row_b", F.col("start").alias("other_start"), F.col("stop").alias("other_stop"), role.alias("role"),
        F.explode(F.sequence(F.floor((F.col("start") - scope) / scope), F.floor((F.col("stop") + scope) / scope))).alias("cell"),
    )
    needs = F.element_at(F.array(*[F.array(*[F.lit(r) for r in NEEDS.get(k, ())]).cast("array<string>") for k in KINDS]), F.col("rank") + 1)
    ends = F.array_distinct(F.array(F.floor(F.col("start") / scope), F.floor(F.col("stop") / scope)))
    weak = parts.filter(F.col("rank") >= 3).withColumn("role", F.explode(needs)).withColumn("cell", F.explode(ends))
    near = (F.col("other_start") - F.col("stop") <= scope) & (F.col("start") - F.col("other_stop") <= scope)
    apart = (F.col("other_start") >= F.col("stop")) | (F.col("other_stop") <= F.col("start"))
    met = weak.alias("w").join(other.alias("o"), ["row_a", "row_b", "role", "cell"]).filter(near & apart)
    return met.groupBy("row_a", "row_b").agg(F.collect_set(F.struct("start", "stop", "rank")).alias("linked"))


def find_secrets(docs: DataFrame, scope: int = 200, kept: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of ``docs``: the columns ``kept``, ``row_a``, ``row_b``, ``sure`` and ``linked`` spans (start, stop, rank in ``KINDS``).

    A null text is empty and has no spans. Equal rows have equal spans. Other columns of ``docs`` don't matter.
    """
    sure, weak = parts_of("text")
    found = stored(docs.select(*kept, *row_key("doc_id", "text"), sure.alias("sure"), weak.alias("weak")), "secret-parts")
    spans_ = found.join(linked(found, scope), ["row_a", "row_b"], "left")
    return spans_.select(*kept, "row_a", "row_b", F.array_sort("sure").alias("sure"), F.array_sort(F.coalesce("linked", F.array().cast(SPAN))).alias("linked"))


def written(spans_: Column) -> Column:
    """Spans as kind:start:stop, by start and then by kind as listed, joined by commas."""
    by_place = F.array_sort(F.transform(spans_, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["stop"].alias("stop"))))
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(by_place, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redacted(text: Column, spans_: Column, mark: str = "[secret]") -> Column:
    """The text with ``mark`` in place of everything that a span covers; overlapping spans become one mark."""

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        fresh = s["start"] >= state["at"]
        out = F.when(fresh, F.concat(state["out"], F.array(gap, F.lit(mark)))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["stop"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(F.array_sort(spans_), start, step, lambda s: F.array_join(F.concat(s["out"], F.array(F.substring(text, s["at"] + 1, F.length(text)))), ""))


def without_secrets(docs: DataFrame, scope: int = 200, mark: str = "[secret]") -> DataFrame:
    """The rows of ``docs`` with ``mark`` in place of every span found; all columns are kept, ``n_chars`` is that of the new text."""
    found = find_secrets(docs, scope, kept=()).select("row_a", "row_b", F.concat("sure", "linked").alias("spans")).filter(F.size("spans") > 0)
    a, b, s = "__finality_row_a", "__finality_row_b", "__finality_spans"
    found = found.dropDuplicates(["row_a", "row_b"]).withColumnsRenamed({"row_a": a, "row_b": b, "spans": s})
    keyed = docs.withColumns(dict(zip((a, b), row_key("doc_id", "text"), strict=True))).join(found, [a, b], "left")
    clean = keyed.withColumn("text", F.when(F.col(s).isNotNull(), redacted(F.col("text"), F.col(s), mark)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col(s).isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return clean.select(*docs.columns)
