"""Secret scans: three patterns plus a randomness test battery, in DataFrame functions only.

Candidates are long tokens of encoding characters with both letters and digits. For each the
encoding (alphabet size k) is inferred and three tests are made against ordinary text or numbers of
its length: chi-squared uniformity over the alphabet (a non-central null that grows with the length),
runs of digits against letters, and serial correlation (both by how much nearer to a random token the
statistic is than text's, in standard errors). The three z values are combined by Stouffer's rule
into one probability, which falls with the length, and the false-discovery rate over all candidates
is controlled by the Benjamini-Hochberg rule on a histogram of those probabilities, which has a fixed
number of bins. All steps are linear in the text's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

#: kind, pattern, capturing group whose length counts, least length
PATTERNS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
FDR = 0.1
#: Signs of an encoding, by their number: how many of them are digits.
DIGITS = {16: 10, 32: 6, 36: 10, 62: 10, 64: 10}
#: The chance that two letters of English text are equal (a published value), and that two digits of a number are.
LETTERS_EQUAL, NUMBERS_EQUAL = 0.065, 0.1
#: By how much chi-squared, divided by the length, exceeds that of random signs for text, or numbers where k is 16.
TEXT_EXCESS = {k: k * (NUMBERS_EQUAL if k == 16 else LETTERS_EQUAL) - 1 for k in DIGITS}
#: What the other two tests hold a token to be text by. Chosen, not measured: identifiers put their digits together,
#: so they change between digits and others half as often as random signs at most; their codes correlate by 0.3.
TEXT_CHANGES, TEXT_SERIAL = 0.5, 0.3
# Coefficients of a Chebyshev fit of erfc with a relative error under 1.2e-7 everywhere.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
#: Matches whose places are summed up together.
CHUNK = 256
BINS_PER_DECADE, BINS = 20, 400
SPAN = "array<struct<start:int,end:int,rank:int,kind:string>>"


def _matches(text: Column, pattern: str, group: int, rank: int, kind: str, least: int) -> Column:
    """Spans of the leftmost non-overlapping matches, in code points, whose group is long enough.

    A match's place follows from the lengths of the matches and of the pieces between them; the
    lengths are summed up in chunks, so that no array is copied once a match.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    parts = F.split(text, pattern, -1)
    sized = F.zip_with(F.zip_with(parts, whole, lambda p, m: F.struct(F.length(p).alias("p"), m.alias("m"))), tested, lambda a, g: F.struct(a["p"].alias("p"), a["m"].alias("m"), g.alias("g")))
    sized = F.filter(sized, lambda x: x["m"].isNotNull())
    fields = "start:int,end:int,rank:int,kind:string,found:string"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<struct<{fields}>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + x["p"]
        b = a + F.length(x["m"])
        span = F.array(F.struct(a.alias("start"), b.alias("end"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["m"].alias("found")))
        return F.struct(b.alias("at"), F.when(F.length(x["g"]) >= least, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    def placed(all_sized: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_sized) - 1) / CHUNK).cast("int")), lambda g: F.slice(all_sized, g * CHUNK + 1, F.lit(CHUNK)))
        return F.transform(chunks, lambda c: F.aggregate(c, start, step))

    def shifted(chunks: Column) -> Column:
        none = F.array().cast("array<int>")
        ahead = F.aggregate(chunks, F.struct(F.lit(0).alias("at"), none.alias("out")), lambda acc, c: F.struct((acc["at"] + c["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        move = lambda by: lambda x: F.struct((x["start"] + by).alias("start"), (x["end"] + by).alias("end"), x["rank"].alias("rank"), x["kind"].alias("kind"), x["found"].alias("found"))
        return F.flatten(F.zip_with(chunks, ahead, lambda c, by: F.transform(c["out"], move(by))))

    found = _with(_with(sized, placed), shifted)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<struct<{fields}>>"))


def _with(value: Column, function) -> Column:
    """``function`` of a value that is evaluated once, not at each of its uses in a lambda."""
    return F.element_at(F.transform(F.array(value), function), 1)


def _normal_below(z: Column) -> Column:
    """Standard normal distribution function, with a small relative error in both tails."""
    x = F.least(F.abs(z), F.lit(30.0)) / 2.0**0.5
    t = 1 / (1 + x / 2)
    power = F.lit(ERFC[-1])
    for c in ERFC[-2::-1]:
        power = power * t + c
    tail = t * F.exp(power - x * x) / 2
    return F.when(z < 0, tail).otherwise(1 - tail)


def _ahead(values: Column) -> Column:
    """For each number of an array (not empty) the greatest before it, -1 for none. In chunks, so that no
    array is copied once a number."""
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / CHUNK).cast("int")), lambda g: F.slice(values, g * CHUNK + 1, F.lit(CHUNK)))
    start = F.struct(F.lit(-1).alias("most"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, v: F.struct(F.greatest(acc["most"], v).alias("most"), F.concat(acc["out"], F.array(acc["most"])).alias("out"))

    def joined(parts: Column) -> Column:
        heads = F.aggregate(F.transform(parts, lambda p: p["most"]), start, step, lambda acc: acc["out"])
        return F.flatten(F.zip_with(parts, heads, lambda p, head: F.transform(p["out"], lambda v: F.greatest(v, head))))

    return _with(F.transform(chunks, lambda c: F.aggregate(c, start, step)), joined)


def _apart(candidates: Column, base: Column) -> Column:
    """The candidates that no base span overlaps. Both are put in the order of their starts: a candidate is
    met by a base span if one that starts before it ends behind its start, or one that starts behind
    its start begins before its end."""
    limit = 1 << 30  # beyond any place in a text
    marked = lambda spans, found, own: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(own).alias("own"), x["end"].alias("end"), found(x).alias("found")))

    def merged(both: Column) -> Column:
        before = _ahead(F.transform(both, lambda x: F.when(x["own"] == 0, x["end"]).otherwise(F.lit(-1))))
        behind = F.reverse(_ahead(F.reverse(F.transform(both, lambda x: F.when(x["own"] == 0, limit - x["start"]).otherwise(F.lit(-1))))))
        met = F.zip_with(before, behind, lambda a, b: F.struct(a.alias("ends"), (limit - b).alias("begins")))
        seen = F.zip_with(both, met, lambda x, m: F.struct(x.alias("x"), ((m["ends"] > x["start"]) | (m["begins"] < x["end"])).alias("met")))
        free = F.filter(seen, lambda s: (s["x"]["own"] == 1) & ~s["met"])
        return F.transform(free, lambda s: F.struct(s["x"]["start"].alias("start"), s["x"]["end"].alias("end"), s["x"]["found"].alias("found")))

    plain = F.transform(candidates, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["found"].alias("found")))
    both = F.array_sort(F.concat(marked(base, lambda x: F.lit(""), 0), marked(candidates, lambda x: x["found"], 1)))
    return F.when((F.size(candidates) == 0) | (F.size(base) == 0), plain).otherwise(_with(both, merged))


def _battery(found: Column) -> Column:
    """Array of candidates to an array of structs start, end, n, k, p. Each step binds its values in a
    struct, so that a token of any length is gone through a fixed number of times (once a sign)."""

    def named(x: Column) -> Column:
        body = x["found"]
        k = (
            F.when(body.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 16).when(body.rlike("^[A-Z2-7]+$"), 32)
            .when(body.rlike("^([A-Z0-9]+|[a-z0-9]+)$"), 36).when(body.rlike("^[A-Za-z0-9]+$"), 62).otherwise(64)
        )
        signs = F.filter(F.split(body, ""), lambda c: c != "")
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), body.alias("body"), F.length(body).cast("double").alias("n"), k.cast("double").alias("k"), signs.alias("signs"))

    def coded(x: Column) -> Column:
        codes = F.transform(x["signs"], lambda c: F.ascii(c).cast("double"))
        counts = F.transform(F.array_distinct(x["signs"]), lambda c: x["n"] - F.length(F.replace(x["body"], c, F.lit(""))))
        squares = F.aggregate(counts, F.lit(0.0), lambda acc, v: acc + v * v)
        digits = F.length(F.regexp_replace(x["body"], "[^0-9]+", ""))
        # every place where a digit follows another sign or the other way round starts a run
        runs = F.regexp_count(x["body"], F.lit("[0-9]+|[^0-9]+")).cast("double")
        total = F.aggregate(codes, F.lit(0.0), lambda acc, v: acc + v)
        return F.struct(
            x["start"].alias("start"), x["end"].alias("end"), x["n"].alias("n"), x["k"].alias("k"), codes.alias("c"), (total / x["n"]).alias("mean"),
            (squares * x["k"] / x["n"] - x["n"]).alias("chi2"), (runs - 1).alias("changes"), ((digits > 0) & (digits < x["n"])).alias("mixed"),
        )

    def correlated(x: Column) -> Column:
        zero = F.struct(F.lit(0.0).alias("before"), F.lit(0.0).alias("spread"), F.lit(0.0).alias("together"))

        def step(acc: Column, v: Column) -> Column:
            d = v - x["mean"]
            return F.struct(d.alias("before"), (acc["spread"] + d * d).alias("spread"), (acc["together"] + acc["before"] * d).alias("together"))

        sums = F.aggregate(x["c"], zero, step, lambda acc: F.when(acc["spread"] > 0, acc["together"] / acc["spread"]).otherwise(F.lit(1.0)))
        return F.struct(*[x[f].alias(f) for f in ("start", "end", "n", "k", "chi2", "changes", "mixed")], sums.alias("serial"))

    def judged(x: Column) -> Column:
        n, k = x["n"], x["k"]
        excess = F.lit(TEXT_EXCESS[64])
        for size, value in TEXT_EXCESS.items():
            excess = F.when(k == size, F.lit(value)).otherwise(excess)
        uniformity = (x["chi2"] - (k - 1) - n * excess) / F.sqrt(2 * (k - 1 + 2 * n * excess))
        digits = F.lit(float(DIGITS[64]))
        for size, value in DIGITS.items():
            digits = F.when(k == size, F.lit(float(value))).otherwise(digits)
        change = 2 * digits / k * (1 - digits / k)
        expected = (n - 1) * change
        runs = (F.abs(x["changes"] - expected) - (1 - TEXT_CHANGES) * expected) / F.sqrt(F.greatest(expected * (1 - change), F.lit(0.25)))
        serial = (F.abs(x["serial"]) - TEXT_SERIAL) * F.sqrt(n)
        p = _normal_below((uniformity + runs + serial) / 3.0**0.5)
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), n.alias("n"), k.alias("k"), F.when(x["mixed"], p).otherwise(F.lit(1.0)).alias("p"))

    for step in (named, coded, correlated, judged):
        found = F.transform(found, step)
    return found


def scan(docs: DataFrame, text_col: str = "text", fdr: float = FDR, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` without the text, with ``base`` and ``added``: arrays of (start, end, rank, kind).

    Null texts count as empty: no spans; very long texts and tokens take time in proportion to their
    length; an empty table stays empty. Equal texts and repeated rows get equal spans. Columns named
    base or added are replaced. Added spans have kind "random" and do not overlap base spans.
    """
    scratch = scratch or Scratch(docs.sparkSession, "secrets")
    kept = [c for c in docs.columns if c not in (text_col, "base", "added")]
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(*kept, *[_matches(text, p, g, i, kind, least).alias(f"__{kind}") for i, (kind, p, g, least) in enumerate(PATTERNS)], _matches(text, CANDIDATE, 0, 3, "random", 20).alias("__c"))
    base = F.array_sort(F.transform(F.concat(*[F.col(f"__{kind}") for kind, *_ in PATTERNS]), lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))))
    base = F.transform(base, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["rank"].alias("rank"), x["kind"].alias("kind")))
    found = found.select(*kept, base.alias("base"), "__c")
    mixed = F.filter("__c", lambda c: c["found"].rlike("[0-9]") & c["found"].rlike("[A-Za-z]"))  # no others are hypotheses
    found = found.select(*kept, "base", mixed.alias("__c")).select(*kept, "base", _apart(F.col("__c"), F.col("base")).alias("__c"))
    rows = scratch.write(found.select(*kept, "base", _battery(F.col("__c")).alias("__c")), "found")

    bins = rows.select(F.explode("__c").alias("c")).select(F.least(F.lit(BINS), F.floor(-F.log10(F.greatest(F.col("c.p"), F.lit(1e-30))) * BINS_PER_DECADE)).cast("int").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    one = Window.partitionBy(F.lit(0))  # at most BINS + 1 rows
    above = F.sum("n").over(one.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0))
    passed = bins.withColumn("ok", F.pow(F.lit(10.0), -F.col("bin") / BINS_PER_DECADE) <= fdr * above / F.sum("n").over(one))
    cut = passed.agg(F.min(F.when(F.col("ok") & (F.col("bin") > 0), F.col("bin"))).alias("__cut"))
    limit = F.pow(F.lit(10.0), -F.col("__cut") / BINS_PER_DECADE)
    kept_c = F.filter("__c", lambda c: c["p"] <= limit)
    added = F.when(F.col("__cut").isNull(), F.array().cast(SPAN)).otherwise(F.transform(kept_c, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.lit(3).alias("rank"), F.lit("random").alias("kind"))))
    return rows.crossJoin(F.broadcast(cut)).select(*kept, "base", added.alias("added"))  # one row is broadcast


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    ordered = F.array_sort(F.transform(F.concat("base", "added"), lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return rows.select("doc_id", *[count(kind) for kind, *_ in PATTERNS], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(ordered).alias("spans"))
