"""Secret scans: three plain patterns and a battery of randomness tests, with Spark expressions only.

Tokens of 20 and more characters that hold a digit and a letter are candidates. The encoding is inferred from the
characters (hexadecimal, base 32, base 64). Were a token random in it, six statistics would be small: chi-squared of symbol
counts and of counts of classes (upper case, lower case, digits) against uniformity, the runs tests about the alphabet's
middle and between classes, the serial correlation of symbol values at distance one, and the count of equal neighbours.
Half the sum of their squares is the token's score.

The null hypothesis is that a token is not random but spelled by people. Its distribution is that of decoys, into which the
whole of every text goes: what is not itself a candidate is glued together, for each encoding, of all words in camel case
(base 64, with a digit a decoy) or of all their characters that the encoding has, and cut from end to end into decoys
of lengths that go round; an end too short for a token belongs to the decoy before it. A token's p-value is the share of decoys of its
encoding and length band that score as low. Per encoding and band, Benjamini and Hochberg's procedure over all candidates of the
corpus then bounds the share of false secrets among those reported as kind `random` by RATE. Bands keep short tokens, whose
tests are weak, apart from long ones; a band without decoys takes those of the next shorter one, which score lower.

Cases: null text is empty; texts and tokens of any length are scanned whole; repeated rows are reported alike; an
empty table gives no rows; other columns are kept, except for the names of the results, which are replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .native import fixed, with_matches

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"  # the whole of 20 characters
HEX = "[0-9a-f]{24,}"
CANDIDATE = "[A-Za-z0-9+/_-]{20,}={0,2}"
#: Those of them with a digit and a letter, which are tested.
TESTED = "(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])" + CANDIDATE
KINDS = ("assign", "access", "hex", "random")
RATE = 0.05
#: The greatest score told apart, in tenths; and the lengths of decoys, the least of each band.
BINS, LENGTHS = 400, (20, 29, 40, 57, 80, 114, 160, 227)
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}


def _spans(found: str, kind: str, keep=lambda m: F.lit(True)) -> Column:
    return F.transform(
        F.filter(found, lambda x: keep(x["match"])),
        lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("k"), x["end"].alias("end")),
    )


def with_base(docs: DataFrame, text: str) -> DataFrame:
    """docs (text without nulls) with _assign, _access and _hex: arrays of (start, k, end)."""
    df = with_matches(docs, text, ASSIGN, "_a")
    df = with_matches(df, text, ACCESS, "_b", F.contains(F.col(text), F.lit("AKIA")))
    df = with_matches(df, text, HEX, "_c")
    long_value = lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= 6
    return df.withColumns({"_assign": _spans("_a", "assign", long_value), "_access": _spans("_b", "access"), "_hex": _spans("_c", "hex")}).drop("_a", "_b", "_c")


def with_candidates(docs: DataFrame, text: str) -> DataFrame:
    """docs with _tokens: array<struct<start, end, encoding, band, bin>>; bin is the score in tenths."""
    df = with_matches(docs, text, CANDIDATE, "_m")
    return scored(df.withColumn("_m", F.filter("_m", lambda x: x["match"].rlike("[0-9]") & x["match"].rlike("[A-Za-z]"))))


def encoding(m: Column) -> Column:
    return F.when(m.rlike("^([0-9a-f]+|[0-9A-F]+)$"), F.lit("hex")).when(m.rlike("^[A-Z2-7]+=*$"), F.lit("base32")).otherwise(F.lit("base64"))


def band(n: Column) -> Column:
    return F.least(F.floor(F.log2(n / 20) * 2), F.lit(12)).cast("int")


def tested(x: Column) -> Column:
    """The score, from what scored() or scored_decoys() counted."""
    n, k, high = x["n"], x["k"], x["high"]
    chi = x["squares"] * k / n - n
    z1 = F.greatest((chi - (k - 1)) / F.sqrt(2 * (k - 1) * (1 - 1 / n)), F.lit(0.0))
    product = 2 * high * (n - high)
    z2 = F.when(product == 0, F.sqrt(n)).otherwise((x["changes"] - product / n) / F.sqrt(F.greatest(product * (product - n) / (n * n * (n - 1)), F.lit(0.25))))
    spread = F.greatest(x["yy"] - x["y"] * x["y"] / n, F.lit(1e-9))
    around = x["yz"] - x["y"] / n * (2 * x["y"] - x["first"] - x["last"]) + (n - 1) * x["y"] * x["y"] / (n * n)
    z3 = (around / spread + 1 / n) * F.sqrt(n)
    z4 = F.greatest((x["equal"] - (n - 1) / k) / F.sqrt((n - 1) / k * (1 - 1 / k)), F.lit(0.0))
    share = lambda of64, of32, of16: F.when(k == 64, of64 / 64).when(k == 32, of32 / 32).otherwise(of16 / 16)
    p0, p1, p2 = share(26, 26, 10), share(26, 6, 6), share(12, 0, 0)
    squared = lambda c, p: (c - n * p) * (c - n * p) / (n * p)
    spread_classes = squared(x["n0"], p0) + squared(x["n1"], p1) + F.when(k == 64, squared(x["n2"], p2)).otherwise(0.0)
    same = p0 * p0 + p1 * p1 + p2 * p2
    z6 = (x["moved"] - (n - 1) * (1 - same)) / F.sqrt((n - 1) * same * (1 - same))
    half = (z1 * z1 + z2 * z2 + z3 * z3 + z4 * z4 + spread_classes + z6 * z6) / 2
    return F.struct(
        x["start"], x["end"], x["encoding"],
        band(n).alias("band"),
        F.least(F.floor(10 * half), F.lit(BINS)).cast("int").alias("bin"),
    )


def scored(df: DataFrame) -> DataFrame:
    """df (_m array<struct<start, end, match>>) with _tokens in its place."""
    alphabet = lambda e: F.when(e == "hex", F.lit(ALPHABETS["hex"])).when(e == "base32", F.lit(ALPHABETS["base32"])).otherwise(F.lit(ALPHABETS["base64"]))

    def named(x: Column) -> Column:
        e = encoding(x["match"])
        plain = F.translate(F.rtrim(F.translate(x["match"], "=", " ")), "-_", "+/")
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), e.alias("encoding"), F.when(e == "hex", F.lower(plain)).otherwise(plain).alias("plain"))

    def valued(x: Column) -> Column:
        values = F.transform(F.split(x["plain"], ""), lambda c: (F.instr(alphabet(x["encoding"]), c) - 1).cast("double"))
        return F.struct(x["start"], x["end"], x["encoding"], values.alias("v"))

    def classed(x: Column) -> Column:
        upper = F.when(x["encoding"] == "hex", 10.0).otherwise(26.0)
        classes = F.transform(x["v"], lambda y: F.when(y < upper, F.lit(0)).when((x["encoding"] == "base64") & (y >= 52), F.lit(2)).otherwise(F.lit(1)))
        return F.struct(x["start"], x["end"], x["encoding"], x["v"], classes.alias("c"))

    def counted(x: Column) -> Column:
        v, n = x["v"], F.size(x["v"]).cast("double")
        k = F.when(x["encoding"] == "hex", 16.0).when(x["encoding"] == "base32", 32.0).otherwise(64.0)
        add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, y: s + y)
        squares = add(F.transform(F.array_distinct(v), lambda c: F.pow(F.size(F.filter(v, lambda y: y == c)), F.lit(2.0))))
        sized = lambda c: F.size(F.filter(x["c"], lambda y: y == c)).cast("double")
        moved = add(F.transform(x["c"], lambda y, i: F.when(i > 0, (y != F.get(x["c"], i - 1)).cast("double")).otherwise(0.0)))
        following = lambda f: F.transform(v, lambda y, i: F.when(i > 0, f(y, F.get(v, i - 1)).cast("double")).otherwise(0.0))
        return F.struct(
            x["start"], x["end"], x["encoding"], n.alias("n"), k.alias("k"), squares.alias("squares"),
            add(F.transform(v, lambda y: (y >= k / 2).cast("double"))).alias("high"),
            add(following(lambda y, z: (y >= k / 2) != (z >= k / 2))).alias("changes"),
            add(following(lambda y, z: y == z)).alias("equal"),
            add(following(lambda y, z: y * z)).alias("yz"),
            add(F.transform(v, lambda y: y.cast("double"))).alias("y"),
            add(F.transform(v, lambda y: (y * y).cast("double"))).alias("yy"),
            F.get(v, F.lit(0)).cast("double").alias("first"), F.element_at(v, -1).cast("double").alias("last"),
            sized(0).alias("n0"), sized(1).alias("n1"), sized(2).alias("n2"), moved.alias("moved"),
        )

    df = df.withColumn("_m", F.transform("_m", named))
    for step in (valued, classed, counted, tested):
        df = df.withColumn("_m", F.transform("_m", step))
    return fixed(df, "_tokens", F.col("_m")).drop("_m")


def _tables(e: str) -> tuple[str, str, str]:
    """SQL arrays for tokens of at most 255 characters of an encoding, whose sums hold all that `counted` counts.

    Places in the alphabet by ASCII code; by place, n0, n1, high, y (14 bits) and yy (20) from the top; by the place before
    (64: none) and the place, moved, changes, equal and yz (20 bits), above the place itself less the one before (7 bits).
    """
    alphabet = ALPHABETS[e]
    k = len(alphabet)
    upper = 10 if e == "hex" else 26
    kind = lambda y: 0 if y < upper else 2 if e == "base64" and y >= 52 else 1
    high = lambda y: 2 * y >= k
    codes = [max(alphabet.find(chr(c)), 0) for c in range(128)]
    single = [(kind(y) == 0) << 50 | (kind(y) == 1) << 42 | high(y) << 34 | y << 20 | y * y for y in range(64)]
    pair = lambda z, y: (kind(z) != kind(y)) << 36 | (high(z) != high(y)) << 28 | (z == y) << 20 | z * y
    pairs = [((pair(z, y) if z < 64 else 0) << 7) + y - z for z in range(65) for y in range(64)]
    return f"array({','.join(map(str, codes))})", *(f"array({','.join(f'{int(x)}L' for x in t)})" for t in (single, pairs))


def with_decoys(docs: DataFrame, text: str, encodings: Iterable[str] = ALPHABETS) -> DataFrame:
    """(encoding, word): all decoys of all texts in these encodings, a row for each."""
    # Equal texts give equal decoys; the text's hash picks the length it begins with.
    turn = F.pmod(F.xxhash64(text), F.lit(10 * len(LENGTHS))).cast("int")
    df = fixed(docs, "_d", F.struct(F.regexp_replace(F.col(text), TESTED, " ").alias("rest"), turn.alias("turn")))
    rest, turn = F.col("_d.rest"), F.col("_d.turn")

    def cut(whole: Column, less: int) -> Column:
        """All of a text without blanks in pieces, each `less` shorter than its decoy."""
        sizes = [n - less for n in LENGTHS]
        turned = [sizes[i:] + sizes[:i] for i in range(len(sizes))]
        patterns = F.array(*[F.lit("(.{1,%d})" % t[0] + "".join("(.{0,%d})" % n for n in t[1:])) for t in turned])
        parted = F.rtrim(F.regexp_replace(whole, F.get(patterns, turn % len(sizes)), F.lit(" ".join(f"${i + 1}" for i in range(len(sizes))) + " ")))
        # An end that is too short goes to the piece before it.
        return F.filter(F.split(F.regexp_replace(parted, " ([^ ]{1,%d})$" % (sizes[0] - 1), "$1"), " "), lambda p: F.char_length(p) >= sizes[0])

    camel = F.replace(F.initcap(F.regexp_replace(F.lower(rest), "[^a-z]+", " ")), F.lit(" "), F.lit(""))
    made = {
        "base64": F.transform(cut(camel, 1), lambda p, i: F.concat(p, F.pmod(turn + i, F.lit(10)).cast("string"))),
        "hex": cut(F.regexp_replace(F.lower(rest), "[^a-f0-9]+", ""), 0),
        "base32": cut(F.regexp_replace(F.upper(rest), "[^A-Z2-7]+", ""), 0),
    }
    of = lambda e, words: F.transform(words, lambda w: F.struct(F.lit(e).alias("encoding"), w.alias("word")))
    return df.select(F.explode(F.concat(*[of(e, words) for e, words in made.items() if e in encodings])).alias("_w")).select("_w.encoding", "_w.word")


def scored_decoys(decoys: DataFrame) -> DataFrame:
    """(encoding, word of at most 255 characters of it) -> _tokens, as scored() gives it: by table, since there are many."""
    tables = {e: [F.expr(t) for t in _tables(e)] for e in ALPHABETS}
    plain = F.when(F.col("encoding") == "hex", F.lower("word")).otherwise(F.col("word"))
    df = fixed(decoys.select("encoding", plain.alias("word")), "_c", F.split("word", ""))

    def per(f) -> Column:
        return F.when(F.col("encoding") == "hex", f(*tables["hex"])).when(F.col("encoding") == "base32", f(*tables["base32"])).otherwise(f(*tables["base64"]))

    n, code = F.size("_c"), lambda codes, c: F.get(codes, F.ascii(c))
    counted = lambda c: (n - F.char_length(F.replace(F.col("word"), c, F.lit("")))).cast("long")
    df = fixed(df, "_k", per(lambda codes, single, pairs: F.transform(F.array_distinct("_c"), lambda c: F.struct(counted(c).alias("n"), code(codes, c).alias("y")))))
    zero = F.lit(0).cast("long")
    singles = lambda codes, single, pairs: F.aggregate("_k", zero, lambda s, x: s + x["n"] * F.get(single, x["y"]))
    neighbours = lambda codes, single, pairs: F.aggregate("_c", F.lit(64).cast("long"), lambda s, c: s + F.get(pairs, (s.bitwiseAND(F.lit(127)) * 64 + code(codes, c)).cast("int")))
    squares = F.aggregate("_k", zero, lambda s, x: s + x["n"] * x["n"]).cast("double")
    first, last = (per(lambda codes, single, pairs, at=at: code(codes, F.element_at("_c", at))).cast("double") for at in (1, -1))
    df = fixed(df, "_s", F.struct(per(singles).alias("one"), F.shiftright(per(neighbours), 7).alias("two"), squares.alias("squares"), first.alias("first"), last.alias("last"), n.cast("long").alias("n")))
    part = lambda x, at, bits: F.shiftright(F.col(x), at).bitwiseAND(F.lit((1 << bits) - 1)).cast("double")
    n = F.col("_s.n").cast("double")
    n0, n1 = part("_s.one", 50, 8), part("_s.one", 42, 8)
    k = F.when(F.col("encoding") == "hex", 16.0).when(F.col("encoding") == "base32", 32.0).otherwise(64.0)
    counts = F.struct(
        F.lit(0).cast("long").alias("start"), F.col("_s.n").alias("end"), F.col("encoding"), n.alias("n"), k.alias("k"), F.col("_s.squares").alias("squares"),
        part("_s.one", 34, 8).alias("high"), part("_s.two", 28, 8).alias("changes"), part("_s.two", 20, 8).alias("equal"), part("_s.two", 0, 20).alias("yz"),
        part("_s.one", 20, 14).alias("y"), part("_s.one", 0, 20).alias("yy"), F.col("_s.first").alias("first"), F.col("_s.last").alias("last"),
        n0.alias("n0"), n1.alias("n1"), (n - n0 - n1).alias("n2"), part("_s.two", 36, 8).alias("moved"),
    )
    return fixed(fixed(df.select("encoding", "_s"), "_m", counts), "_tokens", F.array(tested(F.col("_m"))))


def least_random(candidates: dict[int, int], decoys: dict[int, int], rate: float = RATE) -> int:
    """The greatest bin that Benjamini and Hochberg's procedure takes for random; -1 if none. Both count tokens by bin."""
    m, n, below, at, found = sum(candidates.values()), sum(decoys.values()), 0, 0, -1
    lows = sorted(decoys)
    null = 0
    for b in sorted(candidates):
        below += candidates[b]
        while at < len(lows) and lows[at] <= b:
            null += decoys[lows[at]]
            at += 1
        if b < BINS and (1 + null) / (1 + n) <= rate * below / m:
            found = b
    return found


def thresholds(docs: DataFrame, text: str, rate: float = RATE) -> dict[tuple[str, int], int]:
    """Per encoding and band, the greatest bin that is reported; from all candidates and all decoys.

    The histograms have at most 3 encodings x 13 bands x 401 bins each; so much, and no more, reaches the driver.
    """
    own = docs.select(text)

    def histogram(tokens: DataFrame) -> dict[tuple[str, int], dict[int, int]]:
        counts, _ = materialize(tokens.select(F.explode("_tokens").alias("t")).groupBy("t.encoding", "t.band", "t.bin").count(), "histogram")
        bins: dict[tuple[str, int], dict[int, int]] = {}
        for r in counts.collect():
            bins.setdefault((r.encoding, r.band), {})[r.bin] = r["count"]
        return bins

    candidates = histogram(with_candidates(own, text))
    if not candidates:
        return {}
    # No candidate is held against decoys of another encoding or of a longer band, so those need no score.
    longest = {e: max(b for x, b in candidates if x == e) for e, _ in candidates}
    asked = F.exists(F.array(*[F.struct(F.lit(e).alias("e"), F.lit(b).alias("b")) for e, b in longest.items()]), lambda x: (x["e"] == F.col("encoding")) & (band(F.char_length("word")) <= x["b"]))
    null = histogram(scored_decoys(with_decoys(own, text, longest).where(asked)))
    out = {}
    for (e, b), tokens in candidates.items():
        decoys = next((null[e, x] for x in range(b, -1, -1) if (e, x) in null), {})
        out[e, b] = least_random(tokens, decoys, rate)
    return out


def scan(docs: DataFrame, text: str = "text", rate: float = RATE) -> DataFrame:
    """docs with secrets: array<struct<start, k, end>> in order; k is the place in KINDS; random spans lie clear of base ones."""
    tag = uuid.uuid4().hex[:8]
    kept = [c for c in docs.columns if c.lower() != "secrets"]
    # A caller's columns go along under names of their own, so that no name of this module meets them. They are not put
    # into one struct: taking its fields behind a generator makes Spark 4.1 lose the text (`_extract_text` not found).
    docs = docs.select(
        *[F.col(f"`{c}`").alias(f"_kept{i}_{tag}") for i, c in enumerate(kept)],
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_t"),
    )
    limits = thresholds(docs, "_t", rate)
    df = fixed(with_candidates(with_base(docs, "_t"), "_t"), "_base", F.concat("_assign", "_access", "_hex"))
    if limits:
        most = F.create_map(*[F.lit(y) for (e, b), v in sorted(limits.items()) for y in (f"{e}{b}", v)])
        passed = lambda t: t["bin"] <= F.coalesce(most[F.concat(t["encoding"], t["band"].cast("string"))], F.lit(-1))
        clear = lambda t: ~F.exists("_base", lambda x: (x["start"] < t["end"]) & (t["start"] < x["end"]))
        random = F.transform(
            F.filter("_tokens", lambda t: passed(t) & clear(t)), lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("k"), t["end"].alias("end"))
        )
    else:
        random = F.array().cast("array<struct<start:bigint,k:int,end:bigint>>")
    return df.select(*[F.col(f"_kept{i}_{tag}").alias(c) for i, c in enumerate(kept)], F.sort_array(F.concat("_base", random)).alias("secrets"))


def as_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    own = lambda k: F.size(F.filter("secrets", lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id", own(0).alias("n_assign"), own(1).alias("n_access"), own(2).alias("n_hex"),
        F.sha2(as_text(F.filter("secrets", lambda x: x["k"] < 3)), 256).alias("base_sha256"),
        as_text(F.col("secrets")).alias("spans"),
        own(3).alias("n_random"),
    )


def redact(found: DataFrame, text: str = "text", by: str = "[SECRET]") -> DataFrame:
    """Puts `by` in the place of every span, overlapping ones as one; other texts stay as they are. Drops secrets."""
    spans = F.array().cast("array<struct<start:bigint,end:bigint>>")
    merged = F.aggregate(
        "secrets",
        spans,
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (x["start"] <= F.get(acc, F.size(acc) - 1)["end"]),
            F.concat(
                F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(F.struct(F.get(acc, F.size(acc) - 1)["start"].alias("start"), F.greatest(F.get(acc, F.size(acc) - 1)["end"], x["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"))))),
    )
    df = fixed(found, "_s", merged)
    gaps = F.transform(
        F.sequence(F.lit(0), F.size("_s")),
        lambda i: F.substring(
            F.col(text),
            (F.coalesce(F.get("_s", i - 1)["end"], F.lit(0)) + 1).cast("int"),
            (F.coalesce(F.get("_s", i)["start"], F.char_length(text).cast("long")) - F.coalesce(F.get("_s", i - 1)["end"], F.lit(0))).cast("int"),
        ),
    )
    return df.withColumn(text, F.when(F.size("_s") > 0, F.array_join(gaps, by)).otherwise(F.col(text))).drop("_s", "secrets")
