r"""Secret scan in DataFrame functions alone: fixed patterns and a randomness test battery.

Patterns are matched per kind, leftmost and without overlap. Positions in code points follow
from splitting the text by the same pattern: the gaps before a match and the matches before
it add up to its start.

The battery looks at strings of 16 and more letters, digits and `+/_-` that have both digits
and letters. For the alphabet that a string implies (hex, base32, lower-case or mixed-case
with digits, base64) it tests equal use of the symbols (chi-squared), runs above and below the
middle of the alphabet, and correlation of neighbours. A string is dismissed if it is not
random; a false discovery is then a random string that is dismissed. The Benjamini-Hochberg
bound keeps the share of those below `RATE` within each alphabet and length band, as short
strings give the tests less to go by. What is not dismissed is reported as `random`, unless a
pattern's span covers part of it.

Defined results: a null text is the empty text, which has no spans; repeated rows are reported
each; no string is too long; an empty table gives no rows. A text's spans are gathered in its
row, so memory per row grows with its own matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.session import materialize

# The three patterns of the base scan. A shorter hex or access match cannot
# contain a longer one, so their least lengths stand in the pattern; an assignment that fails
# by length still uses up its text, so that length is tested afterwards.
ASSIGN = (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
          r"([A-Za-z0-9+/_.=-]+)")
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
LEAST_VALUE = 8
CANDIDATE = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}"

KINDS = ("assign", "access", "hex", "random")
#: Alphabets by inference order: name, what the string must consist of, the symbols in order.
ALPHABETS = (
    ("hex", "^[0-9a-f]+$", "0123456789abcdef"),
    ("HEX", "^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", "^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("lower", "^[a-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("upper", "^[A-Z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base64", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"),
)
#: Lower bounds of the length bands.
BANDS = (16, 24, 32, 48, 96)
RATE = 0.05
#: p-values are counted in this many steps, each rounded up.
STEPS = 2000


def _matches(pattern: str, keep: str) -> str:
    """SQL: array of (start, end, token) of the matches that `keep` (over g, group 2 or 0) holds for."""
    p = pattern.replace("\\", "\\\\").replace("'", "\\'")
    group = 2 if pattern == ASSIGN else 0
    return f"""
    CASE WHEN NOT text RLIKE '{p}' THEN array() ELSE
    transform(array(struct(regexp_extract_all(text, '{p}', 0) AS whole,
                           regexp_extract_all(text, '{p}', {group}) AS part,
                           split(text, '{p}', -1) AS gaps)), m ->
      aggregate(sequence(0, size(m.whole) - 1),
        struct(0 AS at, CAST(array() AS array<struct<start:int,end:int,token:string>>) AS out),
        (a, i) -> transform(array(a.at + length(m.gaps[i])), s ->
          transform(array(s + length(m.whole[i])), e -> transform(array(m.part[i]), g ->
            struct(e AS at, CASE WHEN {keep} THEN
              array_append(a.out, named_struct('start', s, 'end', e, 'token', m.whole[i]))
              ELSE a.out END AS out))[0])[0])[0],
        a -> a.out))[0]
    END"""


def _tail(z: str) -> str:
    """SQL: P(a standard normal value exceeds z); the approximation's error is below 1e-7."""
    return f"""transform(array(abs({z}) / sqrt(2D)), x -> transform(array(1 / (1 + 0.3275911D * x)), t ->
      (0.254829592D + t * (-0.284496736D + t * (1.421413741D + t * (-1.453152027D + t * 1.061405429D))))
      * t * exp(-x * x) / 2)[0])[0]"""


def _upper(z: str) -> str:
    return f"transform(array({z}), z -> CASE WHEN z >= 0 THEN {_tail('z')} ELSE 1 - {_tail('z')} END)[0]"


def battery(token: str, symbols: str) -> str:
    """SQL: p-value of the three tests together (Bonferroni) for a string over an alphabet.

    Chi-squared by the cube-root normal approximation; runs and neighbours by their normal
    ones, on both sides. A test that has no spread (all symbols on one side, all equal) says
    nothing about runs or neighbours and counts as 1; the symbols' test sees such strings.
    """
    m = len(symbols)
    letters = "', '".join(symbols)
    chi = (f"aggregate(array('{letters}'), 0D, (a, c) -> "
           f"a + power(n - length(replace(t, c, '')), 2)) * {m} / n - n")
    spread = 2 / (9 * (m - 1))
    return f"""
    transform(array({token}), t -> transform(array(length(t)), n ->
    transform(array(transform(sequence(1, n), i -> locate(substring(t, i, 1), '{symbols}') - 1)), v ->
    transform(array(struct(
      (power(({chi}) / {m - 1}D, 1 / 3D) - {1 - spread!r}D) / sqrt({spread!r}D) AS chi,
      aggregate(v, 0D, (a, x) -> a + IF(x >= {m // 2}, 1, 0)) AS high,
      aggregate(sequence(1, n - 1), 1D, (a, i) -> a + IF((v[i] >= {m // 2}) = (v[i - 1] >= {m // 2}), 0, 1)) AS runs,
      aggregate(v, 0D, (a, x) -> a + x) / n AS mean)), s ->
    transform(array(struct(2 * s.high * (n - s.high) / n + 1 AS mid,
      aggregate(v, 0D, (a, x) -> a + power(x - s.mean, 2)) AS var,
      aggregate(sequence(1, n - 1), 0D, (a, i) -> a + (v[i] - s.mean) * (v[i - 1] - s.mean)) AS lag)), q ->
      least(1D, 3 * least(
        {_upper('s.chi')},
        CASE WHEN (q.mid - 1) * (q.mid - 2) <= 0 THEN 1D ELSE
          2 * {_tail('(s.runs - q.mid) / sqrt((q.mid - 1) * (q.mid - 2) / (n - 1))')} END,
        CASE WHEN q.var <= 0 THEN 1D ELSE
          2 * {_tail('(q.lag / q.var + 1 / (n - 1)) * sqrt(n)')} END)))[0])[0])[0])[0])[0]"""


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
         keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, kept columns and per kind an array of (start, end); `candidates` with p-values."""
    own = {"doc_id", "text", "seen", "candidates", "spans", *KINDS}
    if clash := {k.lower() for k in keep} & own:
        raise ValueError(f"kept columns named like results: {sorted(clash)}")
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), *[F.col(f"`{k}`") for k in keep],
                       F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    bare = "transform({}, x -> struct(x.start AS start, x.end AS end))"
    mixed = "(text RLIKE '[0-9]' AND text RLIKE '[A-Za-z0-9+/_-]{16}')"
    alphabet = " ".join(f"WHEN x.token RLIKE '{rule}' THEN {i}"
                        for i, (_, rule, _) in enumerate(ALPHABETS[:-1]))
    band = " ".join(f"WHEN length(x.token) >= {b} THEN {i}"
                    for i, b in reversed(list(enumerate(BANDS))))
    p = " ".join(f"WHEN {i} THEN {battery('x.token', symbols)}"
                 for i, (_, _, symbols) in enumerate(ALPHABETS))
    has_both = "g RLIKE '[0-9]' AND g RLIKE '[A-Za-z]'"
    found = rows.select(
        "doc_id", *keep, "text",
        F.expr(bare.format(_matches(ASSIGN, f"length(g) >= {LEAST_VALUE}"))).alias("assign"),
        F.expr(bare.format(_matches(ACCESS, "true"))).alias("access"),
        F.expr(bare.format(_matches(HEX, "true"))).alias("hex"),
        F.expr(f"CASE WHEN {mixed} THEN {_matches(CANDIDATE, has_both)} ELSE array() END").alias("seen"))
    return found.withColumn("candidates", F.expr(f"""
        transform(transform(seen, x -> struct(x.start AS start, x.end AS end, x.token AS token,
            CASE {alphabet} ELSE {len(ALPHABETS) - 1} END AS alphabet, CASE {band} ELSE 0 END AS band)),
          x -> struct(x.start AS start, x.end AS end, x.alphabet * 10 + x.band AS stratum,
            CAST(ceil((CASE x.alphabet {p} END) * {STEPS}) AS INT) AS step))""")).drop("seen")


def dismissal_steps(found: DataFrame, rate: float = RATE) -> dict[int, int]:
    """Per stratum the largest step of p that is dismissed. The histogram has at most
    alphabets x bands x steps rows whatever the input; one number per stratum is collected."""
    bins = (found.select(F.explode("candidates").alias("c")).groupBy("c.stratum", "c.step")
            .agg(F.count("*").alias("n")))
    lists = bins.groupBy("stratum").agg(F.sort_array(F.collect_list(F.struct("step", "n"))).alias("b"),
                                        F.sum("n").alias("all"))
    cut = lists.select("stratum", F.expr(f"""
        aggregate(b, struct(0L AS seen, -1 AS cut), (a, x) -> struct(a.seen + x.n AS seen,
          IF(x.step / {STEPS}D <= {rate!r} * (a.seen + x.n) / all, x.step, a.cut) AS cut)).cut""").alias("cut"))
    return {r["stratum"]: r["cut"] for r in cut.collect()}


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
         keep: tuple[str, ...] = (), rate: float = RATE) -> DataFrame:
    """doc_id, kept columns, the four arrays of spans, and `spans`: all as (start, kind, end)
    in order of start, then kind (a place in KINDS). The texts are scanned once."""
    found = materialize(scan(docs, doc_id, text, keep).drop("text"), "secrets")
    return _decided(found, dismissal_steps(found, rate))


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
           rate: float = RATE) -> DataFrame:
    """The rows of `docs` with every span of their text replaced by a mark. The text is scanned
    once for the statistics of the battery and once where it is rewritten; it is not shuffled."""
    cuts = dismissal_steps(materialize(scan(docs, doc_id, text).select("candidates"), "secrets"),
                           rate)
    # The other columns travel in one, so that their names cannot meet those of results.
    row = "carried"
    others = [c for c in docs.columns if c not in (doc_id, text)]
    packed = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"),
                         F.struct(F.lit(0).alias("at"), *[
                             F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]).alias(row))
    found = _decided(scan(packed, keep=(row,)), cuts)
    rewritten = F.when(F.size("spans") > 0, redacted("text", "spans")).otherwise(F.col("text"))
    columns = {doc_id: F.col("doc_id"), text: rewritten,
               **{c: F.col(f"{row}.c{i}") for i, c in enumerate(others)}}
    return found.select(*[columns[c].alias(c) for c in docs.columns])


def _decided(found: DataFrame, cuts: dict[int, int]) -> DataFrame:
    """Candidates that are not dismissed become `random` spans; all spans in order."""
    # At most one entry per alphabet and band.
    known = F.create_map(*[F.lit(x) for pair in cuts.items() for x in pair]) if cuts else None
    stays = (lambda c: c["step"] > F.coalesce(known[c["stratum"]], F.lit(-1))) if cuts else (
        lambda c: F.lit(True))
    base = F.concat("assign", "access", "hex")
    clear = lambda c: ~F.exists(
        base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    found = found.withColumn("random", F.transform(
        F.filter("candidates", lambda c: stays(c) & clear(c)),
        lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end")))).drop("candidates")
    return found.withColumn("spans", _in_order(KINDS))


def _in_order(kinds: tuple[str, ...]) -> Column:
    def numbered(i: int, kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(
            s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end")))

    return F.sort_array(F.concat(*[numbered(i, kind) for i, kind in enumerate(kinds)]))


def written(spans: Column) -> Column:
    """kind:start:end of ordered spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest_columns(found: DataFrame) -> DataFrame:
    """doc_id, the counts of the base kinds, base_sha256 and spans."""
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *counts,
                        F.sha2(written(_in_order(KINDS[:3])), 256).alias("base_sha256"),
                        written(F.col("spans")).alias("spans"))


def redacted(text: str, spans: str, mark: str = "[secret]") -> Column:
    """The text with every span replaced by a mark; spans that overlap give one mark."""
    return F.expr(f"""
        aggregate({spans}, struct(0 AS at, '' AS out), (a, s) -> CASE
            WHEN s.end <= a.at THEN a
            WHEN s.start < a.at THEN struct(s.end AS at, a.out AS out)
            ELSE struct(s.end AS at, concat(a.out, substring({text}, a.at + 1, s.start - a.at), '{mark}') AS out)
          END, a -> concat(a.out, substring({text}, a.at + 1, length({text}) - a.at)))""")
