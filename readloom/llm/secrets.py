"""Secret scans: three patterns and sliding-window entropy, as DataFrame expressions only.

Positions come from cutting a text at a pattern: the lengths of the pieces between matches and of the matches add up to
where each match begins. They count code points; ends are exclusive.

The patterns give the base spans. The entropy scan adds spans: a candidate is a run of 20 or more characters of keys and
encodings. A window of ``WINDOW`` characters slides over it; the sum of n log n over its character counts is carried
along, changed only for the character that enters and the one that leaves, and gives the window's Shannon entropy. The
highest entropy is held against the threshold of the candidate's character class (hexadecimal, letters of one case or of
both with digits, letters of both cases; runs of letters of one case or of digits alone are words and numbers, and never
secrets). Candidates that match the allow-list or touch a base span are suppressed.

Defined cases: a null text counts as empty and has no span; equal spans of one kind cannot occur, and spans that start
together are listed by kind; repeated rows are scanned each on its own; a very long text is scanned whole, in one row;
extra columns, whatever their names, are ignored by ``scan`` and kept by ``redact``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, unused

# Fixed patterns of the base spans, in the order of their kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # equal to AKIA[A-Z0-9]+ matches of 20 and more characters
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = r"[A-Za-z0-9+/=_-]{20,}"
RUN = 512
_MATCHES = "array<struct<start:int,kind:int,end:int,match:string>>"
WINDOW = 20
#: Least entropy in bits of the best window, by class. Of 1,500 random strings of 20 characters each, 1 % or less lie below
#: (hexadecimal, one case with digits in alphabets of 32 and 36, both cases with digits in 62 and 64); letters of both
#: cases alone could be identifiers, so half of the random strings of that class are given up.
LEAST = {"hex": 2.95, "one case": 3.33, "both cases": 3.61, "letters": 4.01}
ALLOW = r"(?i)example|sample|dummy|placeholder|lorem|xxxx|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|[-_=/+]{4,}"


def _spans(text: Column, pattern: str, kind: int, keep: str = "true") -> Column:
    """Array of (start, kind, end, match) of the matches of a pattern for which ``keep`` (over array m, index i) holds."""
    parts, found = F.split(text, F.lit(pattern), -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast(_MATCHES)

    def fold(number: Callable[[Column], Column], count: Column, begin: Column, add: Callable[[Column, Column], Column], empty: Column) -> Column:
        """Struct (at, out) after ``count`` steps from position ``begin``; a step gives (at, item) and its item joins out."""

        def step(state: Column, k: Column) -> Column:
            more = add(state["at"], number(k))
            return F.struct(more["at"].alias("at"), F.concat(state["out"], F.array(more["item"])).alias("out"))

        steps = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, F.struct(begin.alias("at"), empty.alias("out")), step)

    def spans(both: Column) -> Column:
        parts, found = both["parts"], both["found"]
        n = F.size(found)

        def one(at: Column, i: Column) -> Column:
            match = F.get(found, i)
            start = at + F.length(F.get(parts, i))
            end = start + F.length(match)
            return F.struct(end.alias("at"), F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), match.alias("match")).alias("item"))

        def run(at: Column, k: Column) -> Column:
            inner = fold(lambda i: k * RUN + i, F.least(n - k * RUN, F.lit(RUN)), at, one, none)
            return F.struct(inner["at"].alias("at"), inner["out"].alias("item"))

        # arrays grow by copies, so matches are joined in runs and the runs once
        runs = fold(lambda k: k, F.ceil(n / RUN).cast("int"), F.lit(0), run, F.array().cast(f"array<{_MATCHES}>"))
        return F.flatten(runs["out"])

    return let(F.struct(parts.alias("parts"), found.alias("found")), spans)


def _assign(text: Column) -> Column:
    value = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    both = F.arrays_zip(_spans(text, ASSIGN, 0).alias("span"), value.alias("value"))
    return F.transform(F.filter(both, lambda x: F.length(x["value"]) >= 6), lambda x: x["span"])


def max_entropy(token: Column) -> Column:
    """Highest entropy in bits of the windows of ``WINDOW`` characters of an ASCII string (a shorter one is one window)."""
    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c))
    width = F.least(F.lit(WINDOW), F.length(token))

    def part(n: Column) -> Column:
        return F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))

    def slide(state: Column, i: Column) -> Column:
        enter = F.element_at(state["codes"], i)
        leave = F.when(i > WINDOW, F.element_at(state["codes"], F.greatest(i - WINDOW, F.lit(1)))).otherwise(F.lit(-1))
        n, m = F.element_at(state["counts"], enter + 1), F.when(leave >= 0, F.element_at(state["counts"], F.greatest(leave, F.lit(0)) + 1)).otherwise(F.lit(1))
        changed = F.when(enter == leave, F.lit(0.0)).otherwise(part(n + 1) - part(n) + part(m - 1) - part(m))
        total = state["total"] + changed
        counts = F.transform(state["counts"], lambda c, k: c + (k == enter).cast("int") - (k == leave).cast("int"))
        seen = F.when(i >= state["width"], F.log2(state["width"].cast("double")) - total / state["width"]).otherwise(F.lit(0.0))
        return F.struct(state["codes"].alias("codes"), state["width"].alias("width"), counts.alias("counts"), total.alias("total"), F.greatest(state["best"], seen).alias("best"))

    first = F.struct(codes.alias("codes"), width.alias("width"), F.array_repeat(F.lit(0), 128).alias("counts"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"))
    return F.aggregate(F.sequence(F.lit(1), F.length(token)), first, slide, lambda state: state["best"])


def _least_entropy(token: Column) -> Column:
    digit, lower, upper = (token.rlike(p) for p in ("[0-9]", "[a-z]", "[A-Z]"))
    return (
        F.when(~digit & lower & upper, F.lit(LEAST["letters"]))
        .when(~digit | ~(lower | upper), F.lit(99.0))
        .when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), F.lit(LEAST["hex"]))
        .when(lower & upper, F.lit(LEAST["both cases"]))
        .otherwise(F.lit(LEAST["one case"]))
    )


def with_spans(docs: DataFrame, base: str, every: str) -> DataFrame:
    """``docs`` with array columns of (start, kind number, end), sorted: ``base`` of the base spans, ``every`` of all."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast(_MATCHES)
    raw, candidates, more = unused(docs, "_base", "_candidates", "_more")

    def where(guard: Column, found: Column) -> Column:
        return F.when(guard, found).otherwise(none)

    def bare(x: Column) -> Column:
        return F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))

    keyed = text.rlike(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]")
    found = docs.withColumns(
        {
            raw: F.concat(where(keyed, _assign(text)), where(text.contains("AKIA"), _spans(text, ACCESS, 1)), where(text.rlike("[0-9a-f]{24}"), _spans(text, HEX, 2))),
            candidates: where(text.rlike(CANDIDATE), _spans(text, CANDIDATE, 3)),
        }
    )

    def secret(x: Column) -> Column:
        apart = ~F.exists(raw, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
        token, least = x["match"], _least_entropy(x["match"])
        return apart & (least < 99) & ~token.rlike(ALLOW) & (F.when(apart & (least < 99), max_entropy(token)).otherwise(F.lit(0.0)) >= least)

    found = found.withColumn(more, F.when(F.size(candidates) > 0, F.filter(candidates, secret)).otherwise(none))
    return found.withColumns({base: F.array_sort(F.transform(raw, bare)), every: F.array_sort(F.transform(F.concat(raw, more), bare))}).drop(raw, candidates, more)


def _listed(spans: str) -> Column:
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kind, x["kind"] + 1), x["start"], x["end"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): counts by base kind, digest of the base spans, all spans."""

    def count(kind: int) -> Column:
        return F.size(F.filter("base_spans", lambda x: x["kind"] == kind)).cast("long")

    return with_spans(docs.select("doc_id", "text"), "base_spans", "all_spans").select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_listed("base_spans"), 256).alias("base_sha256"), _listed("all_spans").alias("spans")
    )


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by ``mask``; spans that overlap are replaced as one."""

    def step(state: Column, x: Column) -> Column:
        kept = F.when(x["start"] >= state["at"], F.concat(state["out"], F.substring(state["text"], state["at"] + 1, x["start"] - state["at"]), F.lit(mask))).otherwise(state["out"])
        return F.struct(state["text"].alias("text"), kept.alias("out"), F.greatest(state["at"], x["end"]).alias("at"))

    base, every = unused(docs, "base_spans", "all_spans")
    first = F.struct(F.col("text").alias("text"), F.lit("").alias("out"), F.lit(0).alias("at"))
    clean = F.aggregate(every, first, step, lambda s: F.concat(s["out"], F.substring(s["text"], s["at"] + 1, F.length(s["text"]))))
    return with_spans(docs, base, every).withColumn("text", F.when(F.size(every) > 0, clean).otherwise(F.col("text"))).drop(base, every)
