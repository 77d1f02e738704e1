"""Secret scans, in DataFrame functions only.

Base kinds come from patterns. Further spans come from a battery of randomness tests
on long tokens: for the encoding that a token's letters suggest, a chi-squared test of
even use of the alphabet, a runs test and a serial-correlation test give one p-value
under the hypothesis "drawn at random from this alphabet". Tokens are put into strata by
encoding and length, quarters of a power of two. Random tokens spread evenly over p-values while ordinary ones crowd
near 0, so the upper half of a stratum's histogram tells how many random tokens it holds,
and with that the share of false discoveries above each threshold. The threshold of a
stratum is the lowest one that holds the share under the given rate. Each stratum's counts are added to those of
a fixed number of imagined tokens, so strata of a few tokens are judged by the same rule.

A token takes part if the tests can tell an ordinary one of its letters and length from a random one: letters and digits mixed from 16
characters on, digits only or letters of both cases from 20, letters of one case, which words are made of, from 40.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from densegraph.llm.common import let

#: Kinds in order, their patterns, the group whose length counts and its least length.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE_KINDS = [("assign", ASSIGN, 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)]
#: Qualifying matches of patterns whose matches are whole runs of letters, so that shorter ones needn't be located.
LONG = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
#: What stands for the letters of base spans when tokens are sought, a code point that no text should have.
COVERED = "\uFDD0"
TOKEN = rf"[A-Za-z0-9+/_{COVERED}-]{{16,}}"

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings from narrow to wide: name, pattern of a whole token, alphabet.
ENCODINGS = [
    ("digits", r"^[0-9]+$", DIGITS),
    ("lower", r"^[a-z]+$", LOWER),
    ("upper", r"^[A-Z]+$", UPPER),
    ("letters", r"^[A-Za-z]+$", UPPER + LOWER),
    ("hex", r"^[0-9a-f]+$", DIGITS + "abcdef"),
    ("hex_upper", r"^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("base32", r"^[A-Z2-7]+$", UPPER + "234567"),
    ("base36", r"^[0-9a-z]+$", DIGITS + LOWER),
    ("base36_upper", r"^[0-9A-Z]+$", DIGITS + UPPER),
    ("base62", r"^[0-9A-Za-z]+$", DIGITS + UPPER + LOWER),
    ("base64", r"^[0-9A-Za-z+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("base64_url", r"^[0-9A-Za-z_+/-]+$", UPPER + LOWER + DIGITS + "-_"),
]
#: Least lengths of tokens by encoding; 16 for the others.
LEAST_LENGTHS = {"digits": 20, "lower": 40, "upper": 40, "letters": 20}
BINS = 100
#: Imagined tokens of a stratum and the share of random ones among them.
PRIOR, PRIOR_RANDOM = 200, 0.5
NO_SPANS = "array<struct<kind:string,start:int,end:int,rank:int>>"


def running(sizes: Column) -> Column:
    """Sums of an array's values before each one, in blocks of about the square root of their number, so that a long array isn't copied for each value."""

    def before(x: Column) -> Column:
        first = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("done"))
        return F.aggregate(x, first, lambda a, v: F.struct((a["sum"] + v).alias("sum"), F.concat(a["done"], F.array(a["sum"])).alias("done")), lambda a: a["done"])

    def of(x: Column, n: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / n).cast("int")), lambda k: F.slice(x, k * n + 1, n))

        def moved(b: Column) -> Column:
            sums = F.transform(b, lambda y: F.aggregate(y, F.lit(0), lambda u, v: u + v))
            return F.flatten(F.zip_with(b, before(sums), lambda y, at: F.transform(before(y), lambda v: v + at)))

        return let(blocks, moved)

    return let(sizes, lambda x: let(F.ceil(F.sqrt(F.size(x))).cast("int"), lambda n: of(x, n)))


def located(text: Column, pattern: str, body) -> Column:
    """``body(matches, bounds)`` of the matched texts and their (start, end) in code points; null if there is no match.

    Matches and the gaps between them alternate, so positions are running sums of their lengths.
    """

    def bounds(found: Column) -> Column:
        def of(gaps: Column) -> Column:
            gap = lambda i: F.length(F.get(gaps, i))
            sizes = F.transform(found, lambda f, i: F.length(f) + gap(i))
            return F.zip_with(running(sizes), F.transform(found, lambda f, i: F.struct(F.length(f).alias("n"), gap(i).alias("gap"))), lambda at, x: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["n"]).alias("end")))

        return F.when(F.size(found) > 0, let(F.split(text, pattern, -1), lambda g: let(of(g), lambda b: body(found, b))))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), bounds)


def base_spans(text: Column) -> Column:
    """Spans of the base kinds, ordered by start, then kind as listed."""

    def spans(kind: str, rank: int, pattern: str, group: int, least: int) -> Column:
        def body(found: Column, at: Column) -> Column:
            sized = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
            every = lambda s: F.transform(at, lambda b, i: F.struct(F.lit(kind).alias("kind"), b["start"].alias("start"), b["end"].alias("end"), F.when(F.length(F.get(s, i)) >= least, rank).alias("rank")))
            return F.filter(let(sized, every), lambda x: x["rank"].isNotNull())

        # most texts hold no match that is long enough, so positions are worked out only where one is
        return F.coalesce(F.when(text.rlike(LONG.get(kind, ASSIGN.replace("]+)", "]{6,})"))), located(text, LONG.get(kind, pattern), body)), F.array().cast(NO_SPANS))

    every = F.concat(*(spans(k, i, p, g, n) for i, (k, p, g, n) in enumerate(BASE_KINDS)))
    return ordered(every)


def ordered(spans: Column) -> Column:
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.sort_array(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["rank"].alias("rank")))


def upper_tail(z: Column) -> Column:
    """The standard normal upper tail, to 0.0002."""
    z = F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def cube_root_normal(x: Column, df: Column) -> Column:
    """A chi-squared value as a standard normal one, by its cube root."""
    v = F.lit(2.0) / (9 * df)
    return (F.pow(F.greatest(x, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - v)) / F.sqrt(v)


def randomness(token: Column, alphabet: Column) -> Column:
    """The p-value of the three tests together, for a token over an alphabet."""
    size = F.length(alphabet).cast("double")
    n = F.length(token).cast("double")
    letters = lambda t: F.filter(F.split(t, ""), lambda c: c != "")
    squares = F.aggregate(letters(alphabet), F.lit(0.0), lambda a, c: a + F.pow(n - F.length(F.replace(token, c, F.lit(""))), F.lit(2.0)))
    even = F.greatest(cube_root_normal(squares * size / n - n, size - 1), F.lit(0.0))
    codes = F.transform(letters(token), lambda c: F.instr(alphabet, c) - 1)

    def series(x: Column) -> Column:
        high = F.size(F.filter(x, lambda v: 2 * v >= size)).cast("double")
        runs = F.aggregate(
            x, F.struct(F.lit(0.0).alias("runs"), F.lit(0.0).alias("sum"), F.lit(-1).alias("last")),
            lambda a, v: F.struct(
                (a["runs"] + F.when((a["last"] < 0) | ((2 * a["last"] >= size) != (2 * v >= size)), 1.0).otherwise(0.0)).alias("runs"),
                (a["sum"] + F.when(a["last"] < 0, 0.0).otherwise((a["last"] - (size - 1) / 2) * (v - (size - 1) / 2))).alias("sum"),
                v.alias("last"),
            ),
        )

        def both(r: Column) -> Column:
            hl = 2 * high * (n - high)
            spread = F.sqrt(F.greatest(hl * (hl - n) / (n * n * (n - 1)), F.lit(1e-9)))
            runs_z = F.when(hl == 0, 9.0).otherwise((r["runs"] - 1 - hl / n) / spread)
            serial_z = r["sum"] / ((size * size - 1) / 12) / F.sqrt(n - 1)
            return runs_z * runs_z + serial_z * serial_z

        return let(runs, both)

    return upper_tail(cube_root_normal(even * even + let(codes, series), F.lit(3.0)))


#: Code points of a block of text.
BLOCK = 4096


def uncovered(spans: Column) -> Column:
    """For each span, by start: where the text before it that no earlier span covers begins (from 1), its length, the
    letters that the span covers first, and whether it begins after all earlier ones."""
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<lo:int,n:int,own:int,fresh:boolean>>").alias("parts"))

    def step(a: Column, x: Column) -> Column:
        begin = F.greatest(a["at"], x["start"])
        part = F.struct((a["at"] + 1).alias("lo"), (begin - a["at"]).alias("n"), F.greatest(x["end"] - begin, F.lit(0)).alias("own"), (x["start"] >= a["at"]).alias("fresh"))
        return F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.concat(a["parts"], F.array(part)).alias("parts"))

    return F.aggregate(spans, first, step)


def replaced(text: Column, spans: Column, by) -> Column:
    """The text with what each span (by start) covers replaced by ``by`` of its part as uncovered() gives it."""

    # a substring is sought from the beginning of its text, so pieces are taken from the few blocks that they lie in
    whole = lambda x: F.floor(x / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), whole(F.length(text))), lambda k: F.substring(text, k * BLOCK + 1, F.lit(BLOCK)))

    def put(a: Column, b: Column) -> Column:
        piece = lambda lo, n: F.substring(F.array_join(F.slice(b, whole(lo - 1) + 1, whole(lo - 1 + n) - whole(lo - 1) + 1), ""), F.pmod(lo - 1, F.lit(BLOCK)) + 1, n)
        left = F.transform(a["parts"], lambda g: F.concat(piece(g["lo"], g["n"]), by(g)))
        return F.concat(F.array_join(left, ""), F.substring(text, a["at"] + 1, F.length(text)))

    return let(spans, lambda s: F.when(F.size(s) > 0, let(uncovered(s), lambda a: let(blocks, lambda b: put(a, b)))).otherwise(text))


def candidates(text: Column, base: Column) -> Column:
    """Long tokens that no base span touches: start, end, stratum and p-value."""
    least = F.array(*(F.lit(LEAST_LENGTHS.get(e[0], 16)) for e in ENCODINGS))
    names, alphabets = (F.array(*(F.lit(e[j]) for e in ENCODINGS)) for j in (0, 2))

    def encoding(t: Column) -> Column:
        code = F.lit(len(ENCODINGS) - 1)
        for k, (_, pattern, _) in reversed([*enumerate(ENCODINGS)][:-1]):
            code = F.when(t.rlike(pattern), F.lit(k)).otherwise(code)
        return code

    def body(found: Column, at: Column) -> Column:
        mixed = lambda t, c: (c < len(LEAST_LENGTHS)) | t.rlike("[0-9]") & t.rlike("[A-Za-z]")

        def judge(t: Column, b: Column, c: Column) -> Column:
            stratum = F.concat_ws(":", F.get(names, c), F.least(F.floor(4 * F.log2(F.length(t).cast("double"))), F.lit(80)).cast("string"))
            return F.struct(b["start"].alias("start"), b["end"].alias("end"), stratum.alias("stratum"), let(F.get(alphabets, c), lambda x: randomness(t, x)).alias("p"))

        def one(b: Column, t: Column) -> Column:
            return let(encoding(t), lambda c: F.when((F.length(t) >= F.get(least, c)) & mixed(t, c) & ~F.contains(t, F.lit(COVERED)), judge(t, b, c)))

        return F.filter(F.transform(at, lambda b, i: one(b, F.get(found, i))), lambda x: x.isNotNull())

    none = F.array().cast("array<struct<start:int,end:int,stratum:string,p:double>>")
    masked = replaced(text, base, lambda g: F.repeat(F.lit(COVERED), g["own"]))
    return F.coalesce(F.when(text.rlike(TOKEN), let(masked, lambda m: located(m, TOKEN, body))), none)


@dataclass
class Thresholds:
    """For each stratum of encoding and length, the least p-value of a token that counts as random."""

    least: dict[str, float] = field(default_factory=dict)

    def random(self, x: Column) -> Column:
        known = F.create_map(*(F.lit(v) for kv in (self.least or {"": 2.0}).items() for v in kv))
        return x["p"] >= F.coalesce(F.try_element_at(known, x["stratum"]), F.lit(2.0))


def thresholds(histogram: dict[str, dict[int, int]], rate: float) -> Thresholds:
    """From counts of p-values in BINS bins by stratum.

    The imagined tokens are half random, spread evenly, and half ordinary, in the lowest bin.
    Where the upper half falls off by more than chance, its last quarter tells how many tokens are random.
    """
    out = Thresholds()
    for stratum, bins in histogram.items():
        even = PRIOR * PRIOR_RANDOM / BINS
        above = lambda b, bins=bins: sum(n for k, n in bins.items() if k >= b) + even * (BINS - b)
        last = above(3 * BINS // 4)
        third = above(BINS // 2) - last
        truly = 4 * last if third > last + 3 * (third + last) ** 0.5 else 2 * (third + last)
        for b in range(1, BINS // 2 + 1):
            if 1 - (1 - b / BINS) * truly / above(b) <= rate:
                out.least[stratum] = b / BINS
                break
    return out


#: The column of with_spans(); no table that it is used on may have one of this name.
SPANS = "_densegraph_spans"


def with_spans(docs: DataFrame, text_col: str) -> DataFrame:
    """The input with SPANS: its base spans and the candidates of the tests. A null text has none; other columns and repeated rows stay."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.withColumn(SPANS, let(base_spans(text), lambda b: F.struct(b.alias("base"), candidates(text, b).alias("found"))))


def learn(found: DataFrame, rate: float) -> Thresholds:
    """Thresholds from the p-values of all documents; what is collected is at most encodings x lengths x bins counts."""
    each = found.select(F.explode(f"{SPANS}.found").alias("x")).select("x.stratum", F.least(F.floor(F.col("x.p") * BINS), F.lit(BINS - 1)).alias("bin"))
    histogram: dict[str, dict[int, int]] = {}
    for r in each.groupBy("stratum", "bin").count().collect():
        histogram.setdefault(r["stratum"], {})[r["bin"]] = r["count"]
    return thresholds(histogram, rate)


def secret_spans(docs: DataFrame, *, text_col: str = "text", rate: float = 0.05, found: DataFrame | None = None) -> DataFrame:
    """The input with ``base_spans`` and ``secret_spans``: arrays of (kind, start, end, rank) ordered by start, then kind.

    Positions count code points, end exclusive. ``secret_spans`` adds spans of kind ``random`` to
    the base ones, which stay. A null or empty text has none; null ids stay; repeated rows
    get the same spans; an empty table gives no rows. Input columns of the two results' names are replaced, all others
    stay. ``found`` is the table of ``with_spans`` if the caller has written it already.
    """
    found = with_spans(docs, text_col) if found is None else found
    limits = learn(found, rate)
    random = F.transform(F.filter(f"{SPANS}.found", limits.random), lambda x: F.struct(F.lit("random").alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.lit(len(BASE_KINDS)).alias("rank")))
    return found.withColumns({"base_spans": F.col(f"{SPANS}.base"), "secret_spans": ordered(F.concat(f"{SPANS}.base", random))}).drop(SPANS)


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, *, text_col: str = "text", mark: str = "[REDACTED]", rate: float = 0.05, found: DataFrame | None = None) -> DataFrame:
    """The input with every secret span of its texts replaced by ``mark``; overlapping spans get one mark.

    Null and empty texts stay as they are, as do rows with null ids, repeated rows and all other columns, whatever their names;
    an empty table gives no rows. ``found`` is the table of ``with_spans`` over these rows if the caller has written it already.
    """
    found = with_spans(docs, text_col) if found is None else found
    limits = learn(found, rate)
    text = F.col(text_col)
    bounds = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))
    spans = F.sort_array(F.concat(F.transform(f"{SPANS}.base", bounds), F.transform(F.filter(f"{SPANS}.found", limits.random), bounds)))

    cut = replaced(text, spans, lambda g: F.when(g["fresh"], F.lit(mark)).otherwise(F.lit("")))
    return found.withColumn(text_col, cut.cast("string")).drop(SPANS)
