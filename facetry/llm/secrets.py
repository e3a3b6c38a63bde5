r"""Secret scans with multipart credential linking, by SQL functions only.

Base parts are found on their own: ``assign`` (a password-like key with its value), ``access`` (access key ids) and
``hex`` (long lower-case hex runs).  Weak parts mean nothing alone: ``id`` (account-like keys with a value),
``secret`` (long runs of letters and digits) and ``endpoint`` (addresses with a scheme).  A weak part is reported
only if its complement is near: parts are joined when they stand in the same scope, a block of text without a blank
line, and their intervals, widened by ``reach`` code points, meet.  A weak id needs a secret part (assign, hex or
secret), a weak secret needs an identifier (access or id), an endpoint needs both.  Weak parts that overlap a base
part, and weak secrets inside an id or endpoint, are that part already and are not reported twice.

All of this happens inside the row: no shuffle, nothing but the row's own parts in memory.  Weak parts are looked
for only in texts with an identifier.  Positions come from the lengths of what stands between matches, in code
points, end exclusive.  Parts of one kind do not overlap, so begins and ends ascend together, and the interval join
looks each weak part's neighbour of each kind up by bisection: n parts cost n log n steps, not n squared.

Defined cases: null text counts as empty and stays null when redacted.  Other columns pass through ``redacted``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds in listed order and their patterns. Runs of a least length are written with that length.
KINDS = ("assign", "access", "hex", "id", "secret", "endpoint")
ASSIGN = (r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"""
          r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
WEAK_ID = (r"""([cC]lient_?[iI]d|CLIENT_ID|[aA]ccount(_?[iI]d)?|ACCOUNT(_ID)?|[uU]ser(_?[nN]ame)?|USER(_?NAME)?|[lL]ogin|LOGIN)"""
           r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9@_.-]+)""")
RUN = r"[A-Za-z0-9+/_=-]{20,}"
ADDRESS = r"""[A-Za-z][A-Za-z0-9+.-]+://[^\x20\x09-\x0D"'<>]+"""
BLANK_LINE = r"\n[\x20\x09\x0B-\x0D]*\n"
LEAST_VALUE = 6
BLOCK = 256  # lengths that are added up together when places are made

SPAN = "array<struct<start:int,ord:int,end:int>>"


@dataclass(frozen=True)
class SecretParams:
    reach: int = 200


def _none() -> Column:
    return F.array().cast(SPAN)


def _fixed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are computed once for each row, however often a lambda after them looks into them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _found(df: DataFrame, kinds: dict[str, tuple]) -> DataFrame:
    """Columns named by ``kinds``: spans of the matches of (pattern, order, when, check or None), leftmost first.

    ``check`` takes a match and says whether its span stays.  A span's place is the sum of the lengths before it, added
    up in blocks: a block's own place first, then the lengths inside the block.
    """
    text, add = F.col("whole"), lambda a, b: a + b
    of = lambda prefix: {k: F.col(f"{prefix}_{k}") for k in kinds}
    df = _fixed(df, {f"_m_{k}": F.when(when, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))) for k, (pattern, _, when, _) in kinds.items()})
    df = _fixed(df, {f"_p_{k}": F.when(F.size(m) > 0, F.transform(F.split(text, kinds[k][0], -1), lambda x: F.char_length(x))) for k, m in of("_m").items()})
    df = _fixed(df, {f"_l_{k}": F.zip_with(F.slice(F.col(f"_p_{k}"), 1, F.size(m)), m, lambda x, y: x + F.char_length(y)) for k, m in of("_m").items()})
    blocks = lambda x: F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int"))
    df = _fixed(df, {f"_s_{k}": F.transform(blocks(x), lambda b: F.aggregate(F.slice(x, b * BLOCK + 1, BLOCK), F.lit(0), add)) for k, x in of("_l").items()})
    df = _fixed(df, {f"_o_{k}": F.transform(x, lambda _, b: F.aggregate(F.slice(x, F.lit(1), b), F.lit(0), add)) for k, x in of("_s").items()})

    def spans(k: str) -> Column:
        gap, size, block = F.col(f"_p_{k}"), F.col(f"_l_{k}"), F.col(f"_o_{k}")
        order, check = kinds[k][1], kinds[k][3]

        def span(_, i: Column) -> Column:
            b = F.floor(i / BLOCK).cast("int")
            before = F.get(block, b) + F.aggregate(F.slice(size, b * BLOCK + 1, i % BLOCK), F.lit(0), add)
            return F.struct((before + F.get(gap, i)).alias("start"), F.lit(order).alias("ord"), (before + F.get(size, i)).alias("end"))

        found = F.transform(size, span)
        if check is not None:
            found = F.filter(found, lambda _, i: check(F.get(F.col(f"_m_{k}"), i)))
        return F.coalesce(found, _none())

    df = _fixed(df, {k: spans(k) for k in kinds})
    return df.drop(*(f"_{c}_{k}" for c in "mplso" for k in kinds))


def _count_while(spans: Column, holds) -> Column:
    """How many spans, from the first on, satisfy ``holds``, which is true up to some span and false after it."""
    begin = F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi"))

    def halve(at: Column, _: Column) -> Column:
        mid = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        more = F.coalesce(holds(F.get(spans, mid)), F.lit(False))
        return F.struct(F.when((at["lo"] < at["hi"]) & more, mid + 1).otherwise(at["lo"]).alias("lo"),
                        F.when((at["lo"] < at["hi"]) & ~more, mid).otherwise(at["hi"]).alias("hi"))

    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(spans) + 1)).cast("int") + 1)
    return F.aggregate(steps, begin, halve, lambda at: at["lo"])


def _meets(kinds: list[str], s: Column) -> Column:
    """Whether a span overlaps ``s``; spans of one kind do not overlap, so the last that begins before its end decides."""
    last = lambda k: F.get(F.col(k), _count_while(F.col(k), lambda o: o["start"] < s["end"]) - 1)
    return reduce(lambda a, b: a | b, [F.coalesce(last(k)["end"] > s["start"], F.lit(False)) for k in kinds])


def _near(kinds: list[str], s: Column, reach: int) -> Column:
    """Whether a part of the same scope stands within ``reach``; again the last of each kind that begins early enough decides."""
    def last(k: str) -> Column:
        early = lambda o: (o["scope"] < s["scope"]) | ((o["scope"] == s["scope"]) & (o["start"] <= s["end"] + reach))
        return F.get(F.col(k), _count_while(F.col(k), early) - 1)

    close = lambda o: (o["scope"] == s["scope"]) & (s["start"] <= o["end"] + reach)
    return reduce(lambda a, b: a | b, [F.coalesce(close(last(k)), F.lit(False)) for k in kinds])


def with_spans(df: DataFrame, p: SecretParams = SecretParams()) -> DataFrame:
    """Columns ``assign``, ``access``, ``hex`` and ``linked`` (weak parts that are reported) from column ``whole``."""
    text, base = F.col("whole"), ["assign", "access", "hex"]
    long_value = lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= LEAST_VALUE
    df = _found(df, {"access": (ACCESS, 1, text.contains("AKIA"), None), "hex": (HEX, 2, text.rlike(HEX), None),
                     "assign": (ASSIGN, 0, text.rlike(ASSIGN), long_value), "_i": (WEAK_ID, 3, text.rlike(WEAK_ID), None)})
    df = _fixed(df, {"_id": F.filter("_i", lambda s: ~_meets(base, s)), "base": F.concat(*base)})
    named = (F.size("access") > 0) | (F.size("_id") > 0)
    mixed = lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    df = _found(df, {"_u": (ADDRESS, 5, named & text.contains("://"), None), "_r": (RUN, 4, named, mixed)})
    df = _fixed(df, {"_url": F.filter("_u", lambda s: ~_meets(base, s))})
    df = _fixed(df, {"_run": F.filter("_r", lambda s: ~_meets([*base, "_id", "_url"], s))})
    weak = F.size("_id") + F.size("_url") + F.size("_run") > 0
    df = _found(df, {"_blank": (BLANK_LINE, 9, weak, None)})

    def scoped(spans: str) -> Column:
        scope = lambda s: _count_while(F.col("_blank"), lambda b: b["start"] < s["start"])
        return F.when(weak, F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), s["ord"].alias("ord"), s["end"].alias("end"), scope(s).alias("scope"))))

    parts = ["access", "_id", "assign", "hex", "_run", "_url"]
    df = _fixed(df, {f"_in{k}": scoped(k) for k in parts})
    ids, secrets = ["_inaccess", "_in_id"], ["_inassign", "_inhex", "_in_run"]
    linked = [F.filter("_in_id", lambda s: _near(secrets, s, p.reach)), F.filter("_in_run", lambda s: _near(ids, s, p.reach)),
              F.filter("_in_url", lambda s: _near(ids, s, p.reach) & _near(secrets, s, p.reach))]
    plain = F.transform(F.concat(*linked), lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["end"].alias("end")))
    df = _fixed(df, {"linked": F.when(weak, plain).otherwise(_none())})
    return df.drop("_i", "_id", "_u", "_url", "_r", "_run", "_blank", *(f"_in{k}" for k in parts))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.get(names, s["ord"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, p: SecretParams = SecretParams()) -> DataFrame:
    """(doc_id, assign, access, hex, linked, base_spans, spans) of each text."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("whole"))
    found = with_spans(rows, p)
    return found.select("doc_id", "assign", "access", "hex", "linked", _listed(F.col("base")).alias("base_spans"),
                        _listed(F.concat("base", "linked")).alias("spans"))


def redacted(docs: DataFrame, p: SecretParams = SecretParams()) -> DataFrame:
    """Rows of ``docs`` with each found part replaced by its kind in square brackets."""
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("whole"))
    rows = with_spans(rows, p).withColumn("_s", F.array_sort(F.concat("base", "linked")))
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])

    def step(done: Column, s: Column) -> Column:
        gap = F.substring(F.col("whole"), done["at"] + 1, F.greatest(s["start"] - done["at"], F.lit(0)))
        tag = F.when(s["start"] >= done["at"], F.get(names, s["ord"])).otherwise(F.lit(""))
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), F.concat(done["text"], gap, tag).alias("text"))

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))
    clean = F.aggregate("_s", begin, step, lambda d: F.concat(d["text"], F.substring(F.col("whole"), d["at"] + 1, F.char_length("whole"))))
    text = F.when(F.size("_s") > 0, clean).otherwise(F.col("row")["text"])
    return rows.select(*[(text if f == "text" else F.col("row").getField(f)).alias(f) for f in docs.columns])
