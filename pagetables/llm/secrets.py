"""Secrets in texts, found with column expressions only.

Base spans are matches of three patterns. The method adds a battery of randomness tests for every other long run of
encoding characters that mixes digits and letters or the cases of letters, or holds letters of one case only: the narrowest alphabet that holds it is inferred (hexadecimal, base32, digits with letters of one
case, base64), its characters become numbers, and three tests ask whether these look drawn evenly and independently:
chi-squared uniformity over the alphabet, runs above and below the middle, and serial correlation. Their p-values are
combined (Fisher).

A string of chance has a combined p-value that is even on 0 to 1; an ordinary word has one near 0. In each stratum of
alphabet and length, the number of chance strings is estimated from the upper half of the p-values, and the lowest
limit is taken above which the expected share of ordinary words is at most `DISCOVERY_RATE`. Short strings, where words
pass the tests more easily, so get a stricter limit of their own. Limits are drawn from counts over all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagetables.session import stored

DISCOVERY_RATE = 0.05
BINS = 40
KINDS = ("assign", "access", "hex", "random")
# fixed values: patterns and alphabets
PATTERNS = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "random": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}",
}
GUARDS = {
    "assign": "(contains(low, 'password') OR contains(low, 'passwd') OR contains(low, 'secret') OR contains(low, 'token') OR contains(low, 'apikey') OR contains(low, 'api_key'))",
    "access": "contains(text, 'AKIA')",
    "hex": "text RLIKE '[0-9a-f]{24}'",
    "random": "text RLIKE '(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16}'",
}
ALPHABETS = (
    ("0123456789abcdef", "^[0-9a-f]+$"), ("0123456789ABCDEF", "^[0-9A-F]+$"), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "^[A-Z2-7]+$"),
    ("0123456789abcdefghijklmnopqrstuvwxyz", "^[0-9a-z]+$"), ("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "^[0-9A-Z]+$"),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", ""),
)
_NORMAL = "1 / (1 + exp(-(0.07056 * pow({z}, 3) + 1.5976 * {z})))"  # of the normal distribution, to 0.0002


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _starts(lengths: str) -> str:
    """Sums of the elements before each element, linear in practice: by blocks of 64, and within its block."""
    blocks = f"transform(sequence(0, size({lengths}) DIV 64), b -> aggregate(slice({lengths}, CAST(b AS INT) * 64 + 1, 64), 0L, (s, x) -> s + x))"
    heads = f"aggregate({blocks}, array(0L), (s, x) -> array_append(s, element_at(s, -1) + x))"
    return f"""transform(array({heads}), h -> transform(sequence(0, greatest(size({lengths}) - 1, 0)), i ->
        h[CAST(i DIV 64 AS INT)] + aggregate(slice({lengths}, CAST(i DIV 64 AS INT) * 64 + 1, CAST(i % 64 AS INT)), 0L, (s, x) -> s + x)))[0]"""


def _matches(rows: DataFrame, kind: str, group: int) -> DataFrame:
    """Adds the array `kind` of (start, end, body) of all matches; a row that fails the guard gets an empty one."""
    pattern = _literal(PATTERNS[kind])
    none = "CAST(array() AS ARRAY<STRING>)"
    rows = rows.selectExpr(
        "*", f"{GUARDS[kind]} AS guard").selectExpr(
        "* EXCEPT (guard)",
        f"IF(guard, regexp_extract_all(text, {pattern}, 0), {none}) AS hits",
        f"IF(guard, regexp_extract_all(text, {pattern}, {group}), {none}) AS bodies",
        f"IF(guard, split(text, {pattern}, -1), {none}) AS gaps")
    rows = rows.selectExpr("*", "zip_with(slice(gaps, 1, size(hits)), hits, (g, h) -> CAST(length(g) + length(h) AS BIGINT)) AS steps")
    rows = rows.selectExpr("*", f"IF(size(hits) = 0, CAST(array() AS ARRAY<BIGINT>), {_starts('steps')}) AS before")
    return rows.selectExpr("* EXCEPT (hits, bodies, gaps, steps, before)", f"""transform(hits, (h, i) -> named_struct(
        'start', before[i] + length(gaps[i]), 'end', before[i] + length(gaps[i]) + length(h), 'body', bodies[i])) AS `{kind}`""")


def _battery(rows: DataFrame) -> DataFrame:
    """Turns the matches in `random` to (start, end, alphabet, stratum, p)."""
    which = "CASE " + " ".join(f"WHEN c.body RLIKE '{pattern}' THEN {k}" for k, (_, pattern) in enumerate(ALPHABETS[:-1])) + f" ELSE {len(ALPHABETS) - 1} END"
    letters = "array(" + ", ".join(_literal(a) for a, _ in ALPHABETS) + ")"
    steps = [
        "named_struct('start', c.start, 'end', c.end, 'body', translate(rtrim('=', c.body), '-_', '+/'))",
        f"named_struct('start', c.start, 'end', c.end, 'body', c.body, 'k', {which}, 'chars', filter(split(c.body, ''), x -> x <> ''))",
        f"""named_struct('start', c.start, 'end', c.end, 'k', c.k, 'm', CAST(length({letters}[c.k]) AS DOUBLE), 'n', CAST(length(c.body) AS DOUBLE),
            'squares', aggregate(array_distinct(c.chars), 0D, (s, x) -> s + pow(length(c.body) - length(replace(c.body, x, '')), 2)),
            'v', transform(c.chars, x -> CAST(instr({letters}[c.k], x) - 1 AS DOUBLE)))""",
        """named_struct('start', c.start, 'end', c.end, 'k', c.k, 'm', c.m, 'n', c.n, 'squares', c.squares, 'v', c.v,
            'mean', aggregate(c.v, 0D, (s, x) -> s + x) / c.n, 'above', CAST(size(filter(c.v, x -> x >= c.m / 2)) AS DOUBLE),
            'next', slice(c.v, 2, size(c.v)))""",
        """named_struct('start', c.start, 'end', c.end, 'k', c.k, 'm', c.m, 'n', c.n, 'squares', c.squares, 'above', c.above,
            'runs', 1 + aggregate(zip_with(slice(c.v, 1, size(c.next)), c.next, (x, y) -> IF((x >= c.m / 2) = (y >= c.m / 2), 0D, 1D)), 0D, (s, x) -> s + x),
            'spread', aggregate(c.v, 0D, (s, x) -> s + pow(x - c.mean, 2)),
            'serial', aggregate(zip_with(slice(c.v, 1, size(c.next)), c.next, (x, y) -> (x - c.mean) * (y - c.mean)), 0D, (s, x) -> s + x))""",
        """named_struct('start', c.start, 'end', c.end, 'k', c.k, 'n', c.n,
            'z1', (c.m / c.n * c.squares - c.n - (c.m - 1)) / sqrt(2 * (c.m - 1) * (c.n - 1) / c.n),
            'e', 2 * c.above * (c.n - c.above) / c.n + 1, 'runs', c.runs,
            'z3', IF(c.spread = 0, sqrt(c.n), (c.serial / c.spread + 1 / c.n) * sqrt(c.n)))""",
        """named_struct('start', c.start, 'end', c.end, 'k', c.k, 'n', c.n, 'z1', least(greatest(c.z1, -8D), 8D), 'z3', least(abs(c.z3), 8D),
            'z2', least(IF(c.e <= 2, sqrt(c.n), abs(c.runs - c.e) / sqrt((c.e - 1) * (c.e - 2) / (c.n - 1))), 8D))""",
        f"""named_struct('start', c.start, 'end', c.end, 'k', c.k, 'n', c.n, 'half', -ln(greatest(1 - {_NORMAL.format(z='c.z1')}, 1e-300D))
            - ln(greatest(2 - 2 * ({_NORMAL.format(z='c.z2')}), 1e-300D)) - ln(greatest(2 - 2 * ({_NORMAL.format(z='c.z3')}), 1e-300D)))""",
        "named_struct('start', c.start, 'end', c.end, 'stratum', c.k * 100 + CAST(floor(4 * log2(c.n)) AS INT), 'p', exp(-c.half) * (1 + c.half + c.half * c.half / 2))",
    ]
    mixed = "(c.body RLIKE '[0-9]' AND c.body RLIKE '[A-Za-z]') OR c.body RLIKE '[a-z].*[A-Z].*[a-z].*[A-Z]' OR c.body RLIKE '^([A-Z]+|[a-z]+)=*$'"
    rows = rows.withColumn("random", F.expr(f"filter(random, c -> {mixed})"))
    for step in steps:
        rows = rows.withColumn("random", F.expr(f"transform(random, c -> {step})"))
    return rows


def _limits(found: DataFrame) -> dict[int, float]:
    """The lowest p-value taken in each stratum; both counts and strata are bounded, whatever the input."""
    bins = found.select(F.explode("random").alias("c")).select("c.stratum", F.least(F.floor(F.col("c.p") * BINS), F.lit(BINS - 1)).alias("bin"))
    counts = bins.groupBy("stratum", "bin").count()
    upward = Window.partitionBy("stratum").orderBy(F.col("bin").desc())
    whole = Window.partitionBy("stratum")
    chance = F.sum(F.when(F.col("bin") >= BINS // 2, F.col("count")).otherwise(0)).over(whole) / (1 - (BINS // 2) / BINS)
    counts = counts.withColumn("taken", F.sum("count").over(upward)).withColumn("chance", chance)
    good = counts.where(1 - F.col("chance") * (1 - F.col("bin") / BINS) / F.col("taken") <= DISCOVERY_RATE).where("bin > 0 AND chance > 0")
    return {r["stratum"]: r["low"] for r in good.groupBy("stratum").agg((F.min("bin") / BINS).alias("low")).collect()}


def find_spans(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id and the arrays assign, access, hex and random of (start, end).

    Offsets are code points, ends exclusive. A null text is empty; an empty text has no spans. Rows with one id are
    scanned each on its own, and equal ones give equal rows. Columns other than doc_id and text are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("low", F.lower("text"))
    for kind in KINDS:
        rows = _matches(rows, kind, 2 if kind == "assign" else 0)
    rows = rows.selectExpr("doc_id", "filter(assign, c -> length(c.body) >= 6) AS assign", "access", "hex", "random")
    plain = [f"transform({k}, c -> named_struct('start', c.start, 'end', c.end)) AS {k}" for k in KINDS[:3]]
    found = stored(_battery(rows).selectExpr("doc_id", *plain, "random"), "spans")
    limits = _limits(found)
    taken = "CAST(array() AS ARRAY<STRUCT<start: BIGINT, end: BIGINT>>)"
    if limits:
        table = "map(" + ", ".join(f"{k}, {v}D" for k, v in sorted(limits.items())) + ")"
        taken = f"transform(filter(random, c -> c.p >= coalesce({table}[c.stratum], 2D)), c -> named_struct('start', c.start, 'end', c.end))"
    return found.selectExpr("doc_id", *KINDS[:3], f"{taken} AS random")


def _joined(kinds: tuple[str, ...]) -> str:
    tagged = ", ".join(f"transform({k}, c -> named_struct('start', c.start, 'rank', {KINDS.index(k)}, 'end', c.end))" for k in kinds)
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform(array_sort(concat({tagged})), c -> concat_ws(':', {names}[c.rank], c.start, c.end)), ',')"


def span_digests(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, counts of the base kinds, base_sha256 over their spans, and all spans joined."""
    return find_spans(docs).selectExpr(
        "doc_id", *(f"CAST(size({k}) AS BIGINT) AS n_{k}" for k in KINDS[:3]),
        f"sha2({_joined(KINDS[:3])}, 256) AS base_sha256", f"{_joined(KINDS)} AS spans")
