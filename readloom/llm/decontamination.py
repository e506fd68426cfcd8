"""Benchmark decontamination by template windows, as DataFrame expressions only.

A text becomes a row of tokens (runs of letters, single letters of scripts without spaces, or numbers). Numbers, names
(capitalised words inside a sentence) and units become typed placeholders, so a question with other numbers or names has
the same template. Windows of ``WIDTH`` template tokens are hashed and hash-joined with those of the benchmark; a window
with fewer than ``LITERALS`` literal tokens says little as a template and is hashed with its own tokens instead, so
passages full of numbers are found when they are copied. An item of fewer than ``WIDTH`` tokens is one window as wide
as itself.

Windows of a document that line up with an item's at one offset make a stretch. Over all places that these windows cover,
the item's slot values (what its placeholders stand for) must map one to one to the document's. An item is leaked where consistent windows cover ``COVERAGE`` of it; the leak is exact
if all slots are equal, else re-parameterised.

Only hashes of eight bytes meet at first; slots are read again for documents and items that share a window.

Defined cases: null and empty texts have no window; windows that an item repeats count at each of their places; rows that
repeat a doc_id count as one document in ``leaks``, by the best of their texts, and are judged each by its text in ``drop_leaked``; rows that repeat an
item_id are one item with the windows of all, lined up text by text; null doc_ids form one document, null item_ids are no
items; a very long text is cut into windows whole; extra columns, whatever their names, are ignored (``leaks``) or kept
(``drop_leaked``); empty tables give no leaks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, unused

WIDTH = 8
LITERALS = 4
COVERAGE = 0.4
#: Distinct hashes of the benchmark, of eight bytes, up to this number are broadcast; more are joined by shuffling.
BROADCAST_ROWS = 2_000_000

# Fixed list of unit tokens.
UNITS = "mm cm km kg mg ml kb mb gb tb kwh mph kmh km² m² percent dollars dollar euros euro pounds pound cents miles mile meters meter metres metre liters litres hours hour minutes minute seconds second days weeks months years stunden minuten sekunden tage heures jours horas minutos días".split()

_NAME_MARK = "\u0001"
_NAME = r"(?<=[\p{Ll},;:]\x20)(?=\p{Lu}\p{Ll})"
_UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}"
_TOKEN = rf"[{_UNSPACED}]|\x01?[\p{{L}}&&[^{_UNSPACED}]]+|[0-9]+(?:[.,][0-9]+)*"


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.regexp_replace(text, _NAME, _NAME_MARK), F.lit(_TOKEN), F.lit(0))


def _template(tokens: Column) -> Column:
    """Tokens in lower case, or typed placeholders."""

    def one(x: Column) -> Column:
        code = F.ascii(x)
        return F.when(code == 1, F.lit("<name>")).when((code >= 48) & (code <= 57), F.lit("<num>")).otherwise(F.lower(x))

    units = F.array(*[F.lit(u) for u in UNITS])

    def unit(plain: Column) -> Column:
        return F.when(F.arrays_overlap(plain, units), F.transform(plain, lambda x: F.when(F.array_contains(units, x), F.lit("<unit>")).otherwise(x))).otherwise(plain)

    return let(F.transform(tokens, one), unit)


def _is_slot(x: Column) -> Column:
    return F.ascii(x) == 60


def window_hashes(text: Column, widths: list[int]) -> Column:
    """Array of (place, width, hash) of the windows of ``widths`` tokens."""

    def windows(both: Column) -> Column:
        raw, template = both["raw"], both["template"]
        n = F.size(raw)

        def hashed(parts: Column) -> Column:
            kinds, plain, literal, slots = (parts[c] for c in ("kinds", "plain", "literal", "slots"))

            def window(width: int) -> Callable[[Column], Column]:
                return lambda i: one(i, width)

            def one(i: Column, width: int) -> Column:
                few = F.when(slots, sum((F.get(literal, i + k) for k in range(width)), F.lit(0)) < LITERALS).otherwise(width < LITERALS)
                code = F.when(few, F.xxhash64(F.lit(width), *[F.get(plain, i + k) for k in range(width)])).otherwise(F.xxhash64(F.lit(width), *[F.get(kinds, i + k) for k in range(width)]))
                return F.struct(i.cast("int").alias("place"), F.lit(width).alias("width"), code.alias("hash"))

            none = F.array().cast("array<struct<place:int,width:int,hash:bigint>>")
            found = [F.when(n >= w, F.transform(F.sequence(F.lit(0), n - w), window(w))).otherwise(none) for w in widths]
            return F.concat(*found)

        # only windows with more slots than this, or narrow ones, can be short of literals
        slots = F.size(F.filter(template, _is_slot)) > max(min(widths) - LITERALS, 0)
        own = slots | F.lit(min(widths) < LITERALS)
        kinds = F.transform(template, lambda x: F.xxhash64(x))
        plain = F.when(own, F.transform(raw, lambda x: F.xxhash64(F.lower(x), F.lit(1))))
        literal = F.when(slots, F.transform(template, lambda x: (~_is_slot(x)).cast("int")))
        return let(F.struct(kinds.alias("kinds"), plain.alias("plain"), literal.alias("literal"), slots.alias("slots")), hashed)

    return let(_tokens(text), lambda raw: let(F.struct(raw.alias("raw"), _template(raw).alias("template")), windows))


def item_windows(benchmark: DataFrame) -> tuple[DataFrame, list[int]]:
    """item_id, text_key, item_place, width, hash of the benchmark's windows, cut, and the widths that occur."""
    items = benchmark.filter("item_id is not null and text is not null").select("item_id", F.xxhash64("text").alias("text_key"), "text").distinct()
    items = items.withColumn("width", F.least(F.size(_tokens(F.col("text"))), F.lit(WIDTH))).filter("width > 0")
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())  # at most WIDTH rows
    parts = [items.filter(F.col("width") == w).select("item_id", "text_key", F.explode(window_hashes(F.col("text"), [w])).alias("w")) for w in widths]
    if not parts:
        return items.select("item_id", "text_key", F.lit(0).alias("item_place"), "width", F.lit(0).cast("long").alias("hash")).limit(0), []
    known = parts[0]
    for part in parts[1:]:
        known = known.union(part)
    return cut(known.select("item_id", "text_key", F.col("w.place").alias("item_place"), F.col("w.width").alias("width"), F.col("w.hash").alias("hash"))), widths


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows, n_matched, coverage, kind: one row for each leak of a document."""
    found = text_leaks(docs, benchmark)
    own = docs.filter("text is not null").select("doc_id", F.xxhash64("text").alias("key"))
    by_text = own.join(found, "key")
    out = by_text.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_matched", "equal")).alias("best"), F.max("n_windows").alias("n_windows"))
    kind = F.when(F.col("best.equal"), "exact").otherwise("reparameterised")
    return out.select("doc_id", "item_id", "n_windows", F.col("best.n_matched").alias("n_matched"), (F.col("best.n_matched") / F.col("n_windows")).alias("coverage"), kind.alias("kind"))


def text_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """key (hash of a text), item_id, n_windows, n_matched, equal: the items that a text leaks."""
    known, widths = item_windows(benchmark)
    texts = docs.filter("text is not null").select(F.xxhash64("text").alias("key"), "text")
    schema = "key long, item_id long, n_windows long, n_matched long, equal boolean"
    if not widths:
        return docs.sparkSession.createDataFrame([], schema)
    hashes = known.select("hash").distinct()
    small = hashes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    spread = texts.select("key", F.explode(window_hashes(F.col("text"), widths)).alias("w")).select("key", F.col("w.place").alias("place"), F.col("w.hash").alias("hash"))
    hits = cut(spread.join(F.broadcast(hashes) if small else hashes, "hash", "left_semi").distinct())
    totals = known.groupBy("item_id").agg(F.countDistinct("text_key", "item_place").alias("n_windows"))
    # stretches of windows on one diagonal
    aligned = hits.join(known, "hash").groupBy("key", "item_id", "text_key", "width", (F.col("place") - F.col("item_place")).alias("offset")).agg(F.array_sort(F.collect_set("item_place")).alias("places"))
    slim = aligned.select("key").distinct()
    tokens = texts.join(slim, "key", "left_semi").dropDuplicates(["key"]).select("key", _tokens(F.col("text")).alias("doc_tokens"))
    item_texts = benchmark.filter("text is not null").select(F.xxhash64("text").alias("text_key"), "text").dropDuplicates(["text_key"])
    items = item_texts.select("text_key", _tokens(F.col("text")).alias("item_tokens")).withColumn("template", _template(F.col("item_tokens")))
    both = aligned.join(items, "text_key").join(tokens, "key")
    first, last = F.element_at("places", 1), F.element_at("places", -1) + F.col("width") - 1
    covered = F.filter(F.sequence(first, last), lambda i: F.exists("places", lambda p: (p <= i) & (i < p + F.col("width"))))
    pairs = F.transform(covered, lambda i: F.struct(F.get("template", i).alias("kind"), F.get("item_tokens", i).alias("a"), F.get("doc_tokens", i + F.col("offset")).alias("b")))
    slots = F.array_distinct(F.transform(F.filter(pairs, lambda x: _is_slot(x["kind"])), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))))
    judged = both.select("key", "item_id", "text_key", "places", slots.alias("slots"))
    n = F.size("slots")
    one_to_one = (F.size(F.array_distinct(F.transform("slots", lambda x: x["a"]))) == n) & (F.size(F.array_distinct(F.transform("slots", lambda x: x["b"]))) == n)
    consistent = judged.filter(one_to_one).withColumn("equal", F.forall("slots", lambda x: x["a"].eqNullSafe(x["b"])))
    per_text = consistent.groupBy("key", "item_id", "text_key").agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("n_matched"), F.bool_and("equal").alias("equal"))
    found = per_text.groupBy("key", "item_id").agg(F.sum("n_matched").alias("n_matched"), F.bool_and("equal").alias("equal")).join(totals, "item_id")
    return found.filter(F.col("n_matched") / F.col("n_windows") >= COVERAGE).select("key", "item_id", "n_windows", "n_matched", "equal")


def drop_leaked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text leaks an item."""
    (name,) = unused(docs, "leaked_key")
    leaked = text_leaks(docs, benchmark).select(F.col("key").alias(name)).distinct()
    return docs.join(leaked, F.xxhash64(docs["text"]) == leaked[name], "left_anti")
