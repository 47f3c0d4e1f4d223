"""Secret scans: base patterns plus a randomness test battery, all in DataFrame functions.

Base spans are leftmost non-overlapping matches of three patterns, at code-point offsets, end exclusive.
The battery looks at every other run of 20 or more token characters (where base spans are blanked), and at its
parts of 20 or more between separators, if they mix digits and letters or both cases. It infers the encoding
(hex, base32, base36, base62, base64) and makes three tests, each against two hypotheses:

* chi-squared uniformity: over the encoding's alphabet against uniform draws; and how often two letters of
  the run are alike, against the rate in text;
* runs: of symbols above and below the middle of the alphabet; and of character classes, against the rate at which
  identifiers change class (lower in one case than in mixed case);
* serial correlation: of the symbols' ranks; and of vowels with their neighbours, which alternate in text.

What fails any test of randomness (GATE) is no secret. For the others the three tests against text join to one
tail probability, and Benjamini-Hochberg within strata of length (log2) bounds the expected share of text among
what is reported by ALPHA. Where secrets are rare among many text-like runs, short ones need more evidence than
their length gives and are missed; long ones are not. Measured on 23 thousand identifiers and equally many keys
of 20 to 64 characters, see tests/llm. Tail probabilities are counted in fixed bins per stratum, so that no stratum
meets in one task; the table of thresholds has at most STRATA rows.

Offsets and cuts take blocks of about the root of a text's matches, so that a text of many matches costs
little more than its length. Null text counts as empty (no spans). Empty tables give empty results. Repeated rows
are scanned each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigstrata.llm.common import row

#: Fixed patterns of the base scan.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
BASE = ("assign", "access", "hex")
RANDOM = "random"

RUN = r"[A-Za-z0-9+/_=-]{20,}"
SEPARATORS = "[-_+/=]"
LONG = 20
BINS = 400
STRATA = 12
ALPHA = 0.02
GATE = 0.001
#: Text: the chance that two letters are alike and that three are; of a change between vowels and consonants; of a change
#: of class, in identifiers of one case and of both.
ALIKE, ALIKE3, VOWELS, ONE_CASE, TWO_CASES = 0.0667, 0.0053, 0.55, 0.10, 0.25

SPANS = "array<struct<s:int,kind:string,e:int,m:string>>"


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x computed once."""
    return F.transform(F.array(x), f)[0]


def _blocks(a: Column) -> Column:
    """a cut into blocks of about the root of its length."""
    width = F.greatest(F.ceil(F.sqrt(F.size(a))).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / width).cast("int")), lambda b: F.slice(a, b * width + 1, width))


def running(a: Column, add: Callable[[Column, Column], Column]) -> Column:
    """Entry i: add over the entries before i, from 0 on; a is not empty."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def plain(a: Column) -> Column:
        return F.aggregate(
            a, zero, lambda acc, x: F.struct(add(acc["at"], x).cast("int").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"]
        )

    def join(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, x: add(acc, x).cast("int")))
        return F.flatten(F.zip_with(blocks, plain(totals), lambda b, at: F.transform(plain(b), lambda x: add(at, x).cast("int"))))

    return let(a, lambda whole: let(_blocks(whole), join))


def plus(a: Column, b: Column) -> Column:
    return a + b


def _pairs(text: Column, pattern: str) -> Column:
    """array<struct<p, m>> of a pattern's matches m and the lengths p of what stands between the last and it."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    return F.filter(F.arrays_zip(gaps.alias("p"), found.alias("m")), lambda x: x["m"].isNotNull())


def _placed(pairs: Column, kind: str) -> Column:
    """array<struct<s int, kind string, e int, m string>>: the running sum of the lengths gives every offset."""

    def span(x: Column, at: Column) -> Column:
        start = at + x["p"]
        return F.struct(start.alias("s"), F.lit(kind).alias("kind"), (start + F.length(x["m"])).alias("e"), x["m"].alias("m"))

    starts = running(F.transform(pairs, lambda x: x["p"] + F.length(x["m"])), plus)
    return F.when(F.size(pairs) > 0, F.zip_with(pairs, starts, span)).otherwise(F.array().cast(SPANS))


#: Matches of each base kind that pass.
VALID = {
    "assign": lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 12, "access": lambda m: F.length(m) >= 18, "hex": lambda m: F.length(m) >= 16,
}


def with_base(rows: DataFrame, text: Column) -> DataFrame:
    """rows with a column base: all base spans, array<struct<s, kind, e, m>>, by kind and then by start."""
    none = F.array().cast("array<struct<p:int,m:string>>")
    long_hex = HEX[:-1] + "{16,}"  # a run of 16 or more from its first character on is what the pattern finds and the length keeps
    has = {"assign": (text.rlike(ASSIGN), ASSIGN), "access": (text.contains("AKIA"), ACCESS), "hex": (text.rlike(long_hex), long_hex)}
    for kind, (found, pattern) in has.items():
        rows = rows.withColumn(kind, F.when(found, _pairs(text, pattern)).otherwise(none))

    def passing(kind: str) -> Column:
        return F.filter(_placed(F.col(kind), kind), lambda x: VALID[kind](x["m"]))

    each = map(passing, BASE)
    return rows.withColumn("base", F.concat(*each).cast(SPANS)).drop(*BASE)


def _order(spans: Column) -> Column:
    rank = F.transform(
        spans,
        lambda x: F.struct(
            x["s"].alias("s"),
            F.array_position(F.array(*map(F.lit, (*BASE, RANDOM))), x["kind"]).alias("r"),
            x["e"].alias("e"),
            x["kind"].alias("kind"),
        ),
    )
    return F.array_sort(rank)


def _above(z: Column) -> Column:
    """Upper normal tail by the logistic approximation of the normal distribution (error under 0.0002)."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.greatest(F.least(z * (F.lit(1.5976) + F.lit(0.07056) * z * z), F.lit(88.0)), F.lit(-88.0))))


UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: What a run may hold, by encoding: the first that fits is inferred.
KINDS = (
    ("^[0-9a-f]+$", "hex", DIGITS + "abcdef"), ("^[0-9A-F]+$", "hex", DIGITS + "ABCDEF"), ("^[A-Z2-7]+$", "base32", UPPER + "234567"),
    ("^[a-z2-7]+$", "base32", LOWER + "234567"), ("^[a-z0-9]+$", "base36", LOWER + DIGITS), ("^[A-Z0-9]+$", "base36", UPPER + DIGITS),
    ("^[A-Za-z0-9]+$", "base62", UPPER + LOWER + DIGITS), ("^[A-Za-z0-9+/]+$", "base64", UPPER + LOWER + DIGITS + "+/"),
    ("", "base64url", UPPER + LOWER + DIGITS + "-_+/="),
)


#: What the battery computes of a run (s, e, m, part), step by step: each step adds fields to what the last gave, as
#: nothing in a lambda function is computed once only because it is written twice.
def _shape(x: Column) -> dict[str, Column]:
    """The run without padding, without separators, and its letters."""
    return {
        "body": F.translate(F.rtrim(F.translate(x["m"], "=", " ")), " ", "="), "core": F.regexp_replace(x["m"], SEPARATORS, ""),
        "letters": F.lower(F.regexp_replace(x["m"], "[^A-Za-z]", "")), "size": F.length(x["m"]),
    }


def _kind(x: Column) -> dict[str, Column]:
    """The place in KINDS of the encoding that is inferred."""
    first = F.lit(len(KINDS) - 1)
    for i in range(len(KINDS) - 2, -1, -1):
        first = F.when(x["body"].rlike(KINDS[i][0]), i).otherwise(first)
    return {"kind": first}


def _draws(x: Column) -> dict[str, Column]:
    """Symbols, the alphabet, and numbers of symbols, letters and core symbols."""
    alphabet = F.array(*[F.lit(a) for _, _, a in KINDS])[x["kind"]]
    return {
        "symbols": F.filter(F.split(x["body"], ""), lambda c: c != ""), "alphabet": alphabet, "n": F.length(x["body"]).cast("double"),
        "k": F.length(alphabet).cast("double"), "m_letters": F.length(x["letters"]).cast("double"), "n_core": F.length(x["core"]).cast("double"),
    }


def _tallies(x: Column) -> dict[str, Column]:
    """Ranks, squares of the symbols' counts, pairs of like letters, and changes of class and between vowels and consonants."""
    times = lambda text, c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    total = lambda counts, f: F.aggregate(counts, F.lit(0.0), lambda a, c: a + f(c.cast("double")))
    turns = lambda text, pattern: F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).cast("double") - 1.0
    return {
        "ranks": F.transform(x["symbols"], lambda c: F.position(c, x["alphabet"]).cast("double") - 1.0),
        "squares": total(F.transform(F.array_distinct(x["symbols"]), lambda c: times(x["body"], c)), lambda c: c * c),
        "alike": total(F.transform(F.array_distinct(F.filter(F.split(x["letters"], ""), lambda c: c != "")), lambda c: times(x["letters"], c)), lambda c: c * (c - 1.0)),
        "classes": turns(x["core"], "[a-z]+|[A-Z]+|[0-9]+"), "vowels": turns(x["letters"], "[aeiouy]+|[^aeiouy]+"),
        "rate": F.when(x["core"].rlike("[a-z]") & x["core"].rlike("[A-Z]"), TWO_CASES).otherwise(ONE_CASE),
    }


def _folds(x: Column) -> dict[str, Column]:
    """Runs of symbols in the lower and the upper half of the alphabet, and the sums of the lag-1 correlation of ranks."""
    half, mid = x["k"] / 2.0, (x["k"] - 1.0) / 2.0
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("r", "hi", "xy", "xx", "last")], F.lit(-1.0).alias("side"))

    def step(a: Column, v: Column) -> Column:
        side, y = F.when(v >= half, 1.0).otherwise(0.0), v - mid
        return F.struct(
            (a["r"] + F.when(a["side"] == side, 0.0).otherwise(1.0)).alias("r"), (a["hi"] + side).alias("hi"), (a["xy"] + a["last"] * y).alias("xy"),
            (a["xx"] + y * y).alias("xx"), y.alias("last"), side.alias("side"),
        )

    return {"fold": F.aggregate(x["ranks"], zero, step)}


def _means(x: Column) -> dict[str, Column]:
    """What the number of runs should be, and the pairs of letters."""
    hi = x["fold"]["hi"]
    return {"mean": 2.0 * hi * (x["n"] - hi) / x["n"] + 1.0, "pairs": x["m_letters"] * (x["m_letters"] - 1.0)}


def _scores(x: Column) -> dict[str, Column]:
    """Standardised distances: from randomness, the larger the less random; and from text, joined, the larger the less like it."""
    n, k, m, fold, one = x["n"], x["k"], x["m_letters"], x["fold"], F.lit(1.0)
    chi = (x["squares"] * k / n - n - (k - 1.0)) / F.sqrt(2.0 * (k - 1.0) * F.greatest(1.0 - 1.0 / n, F.lit(1e-9)))
    var = (x["mean"] - 1.0) * (x["mean"] - 2.0) / F.greatest(n - 1.0, one)
    runs = F.when(var <= 0.0, F.lit(88.0)).otherwise(F.abs(fold["r"] - x["mean"]) / F.sqrt(F.greatest(var, F.lit(1e-9))))
    serial = F.abs(fold["xy"]) / F.greatest(fold["xx"], F.lit(1e-9)) * F.sqrt(n)
    spread = F.sqrt(2.0 * x["pairs"] * (ALIKE - ALIKE**2) + 4.0 * x["pairs"] * F.greatest(m - 2.0, F.lit(0.0)) * (ALIKE3 - ALIKE**2))
    alike = F.when(m > 1, (x["pairs"] * ALIKE - x["alike"]) / F.greatest(spread, F.lit(1e-9))).otherwise(0.0)
    changes = (x["classes"] - (x["n_core"] - 1.0) * x["rate"]) / F.sqrt(F.greatest(x["n_core"] - 1.0, one) * x["rate"] * (1.0 - x["rate"]))
    turns = ((m - 1.0) * VOWELS - x["vowels"]) / F.sqrt(F.greatest(m - 1.0, one) * VOWELS * (1 - VOWELS))
    # the first of the three is one-sided, the others have two tails each, and Bonferroni joins them
    # what alternates vowels more than text does is text, however often digits strewn between words change the class
    return {"text": F.when(turns < -1.0, F.lit(-88.0)).otherwise((alike + changes + turns) / 3.0**0.5), "chi": chi, "runs": runs, "serial": serial}


def _tails(x: Column) -> dict[str, Column]:
    random = F.least(3.0 * _above(x["chi"]), 6.0 * _above(x["runs"]), 6.0 * _above(x["serial"]))
    return {"p": F.when((x["n_core"] < 16) | (random < GATE), 1.0).otherwise(_above(x["text"]))}


STEPS = (_shape, _kind, _draws, _tallies, _folds, _means, _scores, _tails)


def battery(runs: Column) -> Column:
    """array<struct<s, e, part, size, kind, p>> of runs (s, e, m, part): p is the tail probability of a run's tests
    under text, 1 where a test of randomness fails; kind is the place of its encoding in KINDS."""
    have = ["s", "e", "m", "part"]
    for step in STEPS:

        def each(x: Column) -> Column:
            made = step(x)
            names.extend(made)
            return F.struct(*[x[c].alias(c) for c in have], *[v.alias(c) for c, v in made.items()])

        names: list[str] = []
        runs = F.transform(runs, each)
        have = have + names
    return runs


def judged(x: Column) -> Column:
    """A tested run's stratum of length, and the bin of its tail probability."""
    bin_ = F.least(F.floor(-10.0 * F.log10(F.greatest(x["p"], F.lit(1e-39)))), F.lit(BINS - 1)).cast("int")
    stratum = F.least(F.floor(F.log2(x["size"].cast("double"))), F.lit(STRATA)).cast("int")
    return F.struct(x["s"].alias("s"), x["e"].alias("e"), x["part"].alias("part"), stratum.alias("stratum"), bin_.alias("bin"), x["kind"].alias("kind"))


def _eligible(m: Column) -> Column:
    return m.rlike("[A-Za-z]") & (m.rlike("[0-9]") | (m.rlike("[a-z]") & m.rlike("[A-Z]")))


def _with_parts(x: Column) -> Column:
    """A run (s, e, m), and after it its parts between separators, as array<struct<s, e, m, part>>."""
    whole = F.array(F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), F.lit(False).alias("part")))

    def placed(ps: Column) -> Column:
        starts = running(F.transform(ps, lambda p: F.length(p) + 1), plus)
        each = F.zip_with(
            ps, starts, lambda p, at: F.struct((x["s"] + at).alias("s"), (x["s"] + at + F.length(p)).alias("e"), p.alias("m"), F.lit(True).alias("part"))
        )
        return F.concat(whole, F.filter(each, lambda y: (F.length(y["m"]) >= LONG) & _eligible(y["m"])))

    return F.when(x["m"].rlike(SEPARATORS), let(F.split(x["m"], SEPARATORS, -1), placed)).otherwise(whole)


def scanned(rows: DataFrame, text: str) -> DataFrame:
    """rows with columns base (spans) and cand of a text column; null counts as empty.

    cand: array<struct<s, e, part, stratum, bin, kind>> of the runs outside base spans, each followed by its parts.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    out = with_base(rows, whole)
    blank = F.when(F.size("base") > 0, masked(whole, _order(F.col("base")), lambda n: F.repeat(F.lit(" "), n), False)).otherwise(whole)
    none = F.array().cast("array<struct<p:int,m:string>>")
    out = out.withColumn("blank", F.when(whole.rlike(RUN), blank)).withColumn("runs", F.when(F.col("blank").isNotNull(), _pairs(F.col("blank"), RUN)).otherwise(none))
    out = out.withColumn("runs", F.filter(_placed(F.col("runs"), RANDOM), lambda x: _eligible(x["m"])))
    out = out.withColumn("runs", F.flatten(F.transform("runs", _with_parts)))
    return out.withColumn("cand", F.transform(battery(F.col("runs")), judged)).drop("runs", "blank")


def masked(text: Column, spans: Column, fill: Callable[[Column], Column], once: bool) -> Column:
    """text with what ordered spans (one at least) cover replaced by fill(its length); `once`: one fill where spans overlap."""

    def gap(text: Column, at: Column, x: Column) -> Column:
        return F.when(x["s"] > x["a"], F.substring(text, at + 1, x["s"] - x["a"])).otherwise("")

    def piece(text: Column, first: Column, x: Column) -> Column:
        more = F.greatest(x["e"] - F.greatest(x["a"], x["s"]), F.lit(0))
        return F.when(x["s"] < x["a"], F.lit("") if once else fill(more)).otherwise(F.concat(gap(text, x["a"] - first, x), fill(more)))

    def block(b: Column) -> Column:
        start, last = b[0]["a"], F.element_at(b, -1)
        part = F.substring(text, start + 1, F.greatest(last["s"], last["a"]) - start)
        return let(part, lambda t: F.array_join(F.transform(b, lambda x: piece(t, start, x)), ""))

    # a: where the text not yet covered begins, before this span
    ends = running(F.transform(spans, lambda x: x["e"]), lambda a, b: F.greatest(a, b))
    items = F.zip_with(spans, ends, lambda x, a: F.struct(a.alias("a"), x["s"].alias("s"), x["e"].alias("e")))
    rest = F.substring(text, F.array_max(F.transform(spans, lambda x: x["e"])) + 1, F.length(text))
    return F.concat(F.array_join(F.flatten(F.transform(F.array(items), lambda i: F.transform(_blocks(i), block))), ""), rest)


def thresholds(scan: DataFrame) -> dict[int, int]:
    """Benjamini-Hochberg per stratum: the least bin whose candidates, and those of all bins above, are secrets.

    Reads counts by (stratum, bin): at most (STRATA + 1) * BINS rows come to the driver.
    """
    # outer: the filter that a plain explode brings would be pushed below the battery, which would be written out in it
    each = scan.select(F.explode_outer("cand").alias("c"))
    seen = each.groupBy(F.col("c.stratum").alias("t"), F.col("c.bin").alias("b")).count().collect()
    out = {}
    for t in {r.t for r in seen if r.t is not None}:
        counts = {r.b: r["count"] for r in seen if r.t == t}
        m, cum = sum(counts.values()), 0
        for b in range(BINS - 1, 0, -1):
            cum += counts.get(b, 0)
            if cum and 10 ** (-b / 10) * m <= ALPHA * cum:
                out[t] = b
    return out


def with_spans(scan: DataFrame, limits: dict[int, int]) -> DataFrame:
    """scan with a column spans: base spans and the runs that pass the battery, or else those of their parts that do,
    in order, array<struct<s, r, e, kind>>."""

    def passes(x: Column) -> Column:
        out = F.lit(BINS)
        for t, b in sorted(limits.items()):
            out = F.when(x["stratum"] == t, b).otherwise(out)
        return x["bin"] >= out

    found = F.filter("cand", passes)
    # a part comes after its run: where that has passed, it ends no later than what has passed before it
    ends = running(F.transform("found", lambda x: F.when(x["part"], 0).otherwise(x["e"])), lambda a, b: F.greatest(a, b))
    each = F.zip_with(F.col("found"), ends, lambda x, a: F.struct(x["s"].alias("s"), F.lit(RANDOM).alias("kind"), x["e"].alias("e"), F.when(x["part"] & (x["e"] <= a), "").alias("m")))
    kept = F.when(F.size("found") > 0, F.filter(each, lambda x: x["m"].isNull())).otherwise(F.array().cast(SPANS))
    return scan.withColumn("found", found).withColumn("spans", _order(F.concat("base", kept.cast(SPANS)))).drop("found")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan_documents(docs: DataFrame, write) -> DataFrame:
    """doc_id, counts of base kinds, digests and spans; write(df) makes a table that is read twice."""
    scan = write(scanned(docs.select("doc_id", "text"), "text").select("doc_id", "base", "cand"))
    limits = thresholds(scan)
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return with_spans(scan, limits).select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(_order(F.col("base"))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda x: x["kind"] == RANDOM)).cast("long").alias("n_random"),
    )


def redact_documents(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every stretch that spans cover replaced by one mark, and n_chars of the new text; every row stays.

    Thresholds come from one pass over all texts, the redaction from a second: nothing but counts is shuffled.
    """
    scan = scanned(row(docs), "row.text")
    limits = thresholds(scan)
    clean = masked(F.col("row.text"), F.col("spans"), lambda n: F.lit(mark), True)
    hidden = with_spans(scan, limits).withColumn("clean", F.when(F.size("spans") > 0, clean).otherwise(F.col("row.text")))
    own = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        length = F.length("clean").cast(docs.schema["n_chars"].dataType)
        own["n_chars"] = F.when(F.size("spans") > 0, length).otherwise(F.col("row.n_chars"))
    return hidden.select(*[own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
