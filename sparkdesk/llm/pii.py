"""Personal data by weak supervision, with DataFrame functions only.

1. Candidates.  Each text is cut by a pattern per kind of personal data (the
   base kinds e-mail, IP address, card and phone number) and by one pattern of
   further shapes (national phone numbers, written-out e-mail addresses,
   identity numbers, access tokens).  ``split`` and ``regexp_extract_all``
   with the same pattern give pieces and matches in turn, and a running sum of
   their lengths gives offsets in code points.
2. Votes.  Four labelers vote -1, 0 or 1 on every candidate: *shape* (a strict
   pattern), *gazetteer* (issuer prefixes, country codes, top-level domains,
   key names), *context* (cue or counter-cue words beside it) and *check*
   (checksum, digit count, mixture of characters).
3. Reliabilities.  Expectation-maximisation over the counts of vote patterns
   (at most 3**4 per kind, counted over the whole corpus) estimates how each
   labeler votes on true and false candidates.
4. Classifier.  A logistic regression over votes, kind and length class is
   fitted to the estimated probabilities and decides on every candidate that
   is not a base span.  Base spans always stay.

The patterns are possessive and start a run of characters only where the run
starts (or where the last match ended), so long runs cost linear time.

Defined results: null text has no spans (as an empty one); repeated rows get
repeated results; ties in start are ordered by kind as listed in ``KINDS``;
an empty table gives an empty result and a classifier that accepts nothing;
extra columns pass through ``mask`` and are ignored elsewhere.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from sparkdesk.llm.common import free_name
from sparkdesk.session import materialize

# The base kinds and their patterns, then the further kinds.
KINDS = ["email", "ip", "card", "phone", "id", "secret"]
BASE = KINDS[:4]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
FURTHER = "|".join([
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]{1,64}+\x20?[\[(][Aa][Tt][\])]\x20?[A-Za-z0-9-]{1,64}+"
    r"(?:(?:\.|\x20?[\[(][Dd][Oo][Tt][\])]\x20?)[A-Za-z0-9-]{1,64}+){1,8}+",
    r"(?<![0-9.(-])(?<!\+[0-9]{1,3}\x20)(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9-])",
    r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    r"(?<![A-Za-z0-9])(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\x20{0,3}[=:]\x20{0,3}"
    r"[\"']?[A-Za-z0-9+/_-]{12,}+",
])
VALUE = r"[A-Za-z0-9+/_-]+\z"             # of a secret: what follows the name and the sign
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
# Gazetteers.
TOP_LEVEL = r"\.(?:com|org|net|edu|gov|io|info|biz|de|fr|es|uk|eu|us|ca|au|in|it|nl|ch|at|be|mx|ar|br|jp|cn|ru)\z"
CARD_ISSUER = r"\A(?:4|5[1-5]|2[2-7]|3[47]|3[068]|35|6011|6[245])"
COUNTRY_CODE = r"\A\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
SPECIAL_NET = r"\A0*(?:0|10|127|169\.0*254|192\.0*168|22[4-9]|2[3-5][0-9])\."
# Words beside a candidate, for it and against it.
CUES = {
    "email": r"(?i)\b(?:mail|e-mail|email|contact|write|correo|courriel|kontakt)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|client|login|adresse)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|cell|fax|telefon|appelez|llame)\b",
    "id": r"(?i)\b(?:ssn|social|security|passport|taxpayer|id)\b",
    "secret": r"(?i)\b(?:token|secret|password|passwd|key)\b",
}
COUNTER_CUES = r"(?i)\b(?:version|page|chapter|section|figure|order|invoice|isbn|issn|rfc|pp|vol|example)\b"
LABELERS = ["shape", "gazetteer", "context", "check"]
LENGTHS = (8, 14, 20, 40)                 # upper ends of the length classes
LEFT, RIGHT = 32, 16                      # code points of context
BLOCK = 512                               # running sums are appended to in blocks of this many


def running_sum(lengths: Column) -> Column:
    """Inclusive running sums of an int array, appended block by block so that long arrays
    are not copied once per element."""
    none, blocks = F.array().cast("array<int>"), F.array().cast("array<array<int>>")
    start = F.struct(blocks.alias("done"), none.alias("now"), F.lit(0).alias("sum"))

    def step(s, x):
        total = s["sum"] + x
        return F.when(F.size(s["now"]) < BLOCK, F.struct(
            s["done"].alias("done"), F.concat(s["now"], F.array(total)).alias("now"), total.alias("sum"))
        ).otherwise(F.struct(F.concat(s["done"], F.array(s["now"])).alias("done"),
                             F.array(total).alias("now"), total.alias("sum")))

    return F.aggregate(lengths, start, step, lambda s: F.flatten(F.concat(s["done"], F.array(s["now"]))))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn_ok(number: Column) -> Column:
    """Luhn checksum of a string of digits."""
    back = F.reverse(number)
    plain = F.regexp_replace(back, "(.).?", "$1")
    doubled = F.translate(F.regexp_replace(back, ".(.)?", "$1"), "0123456789", "0246813579")
    total = F.aggregate(F.split(F.concat(plain, doubled), ""), F.lit(0),
                        lambda s, d: s + F.coalesce(d.try_cast("int"), F.lit(0)))
    return total % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    """Whether a match of a base pattern is a base span."""
    if kind == "ip":
        return m.rlike(rf"\A{OCTET}(?:\.{OCTET}){{3}}\z")
    if kind == "card":
        n = digits(m)
        return F.length(n).between(14, 19) & luhn_ok(n)
    if kind == "phone":
        return F.length(digits(m)).between(10, 15)
    return F.lit(True)


def _votes(kind: Column, m: Column, left: Column, right: Column) -> list[Column]:
    """The votes of LABELERS on a candidate, as ints."""
    n = digits(m)

    def by_kind(**votes):
        out = F.lit(0)
        for k, v in votes.items():
            out = F.when(kind == k, v).otherwise(out)
        return out

    yes_no = lambda c: F.when(c, 1).otherwise(-1)       # noqa: E731
    shape = by_kind(
        email=yes_no(m.rlike(r"\A[A-Za-z0-9][A-Za-z0-9._%+-]*(?:@|\x20?[\[(])")),
        ip=yes_no(m.rlike(r"\A(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}\z")),
        card=yes_no(m.rlike(r"\A(?:[0-9]{14,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})\z")),
        phone=yes_no(m.rlike(r"\A(?:\+[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{2,5}[0-9\x20.-]*\z")),
        id=yes_no(~m.rlike(r"\A(?:000|666|9)|-00-|-0000\z")),
        secret=yes_no(m.rlike(r"[A-Za-z0-9+/_-]{20,}\z")))
    gazetteer = by_kind(
        email=yes_no(F.lower(m).rlike(TOP_LEVEL)),
        ip=yes_no(~m.rlike(SPECIAL_NET)),
        card=yes_no(n.rlike(CARD_ISSUER)),
        phone=F.when(m.rlike(COUNTRY_CODE), 1).when(m.startswith("+"), -1).otherwise(0))
    cue = by_kind(**{k: F.when(F.concat_ws(" ", left, right).rlike(v), 1).otherwise(0) for k, v in CUES.items()})
    context = F.when(cue == 1, 1).when(left.rlike(COUNTER_CUES), -1).otherwise(0)
    check = by_kind(
        email=yes_no(F.length(m).between(6, 80)),
        ip=yes_no(m.rlike(rf"\A{OCTET}(?:\.{OCTET}){{3}}\z")),
        card=yes_no(F.length(n).between(14, 19) & luhn_ok(n)),
        phone=yes_no(F.length(n).between(10, 15)),
        id=yes_no(F.length(n) == 9),
        secret=yes_no(m.rlike(r"[0-9]") & m.rlike(r"[A-Za-z]")))
    return [v.alias(name) for v, name in zip((shape, gazetteer, context, check), LABELERS)]


def candidates(docs: DataFrame, text_col: str, out: str) -> DataFrame:
    """``docs`` with ``out``: the candidates of each text, an array of structs of start,
    end (code points, exclusive), kind, base (whether a base span), votes and length."""
    names = [*BASE, "further"]
    patterns = [*(PATTERNS[k] for k in BASE), FURTHER]
    m, g, e, f = ([free_name(docs, f"_{p}_{n}") for n in names] for p in "mgef")
    text = F.coalesce(F.col(text_col), F.lit(""))
    cut = docs.select(
        *docs.columns,
        *[F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias(a) for p, a in zip(patterns, m)],
        *[F.transform(F.split(text, p, -1), lambda x: F.struct(
            F.length(x).alias("n"), F.right(x, F.lit(LEFT)).alias("tail"),
            F.left(x, F.lit(RIGHT)).alias("head"))).alias(b) for p, b in zip(patterns, g)])
    placed = cut.select(
        *cut.columns,
        *[F.when(F.size(a) > 0, running_sum(F.zip_with(F.slice(b, 1, F.size(a)), a, lambda x, y: x["n"] + F.length(y))))
          .alias(c) for a, b, c in zip(m, g, e)])

    def found(a, b, c):
        rows = F.arrays_zip(F.col(a).alias("m"), F.col(c).alias("e"),
                            F.slice(b, 1, F.size(a)).alias("l"), F.slice(b, 2, F.size(a)).alias("r"))
        return F.when(F.size(a) > 0, rows)

    zipped = placed.select(*docs.columns, *[found(a, b, c).alias(d) for a, b, c, d in zip(m, g, e, f)])

    def spans(kind, d):
        def one(z):
            match = z["m"]
            if kind == "further":
                k = (F.when(match.rlike(r"[=:]"), "secret").when(match.rlike(r"(?i)[\[(]at[\])]"), "email")
                     .when(match.rlike(r"\A[0-9]{3}-[0-9]{2}-"), "id").otherwise("phone"))
                start = z["e"] - F.when(k == "secret", F.length(F.regexp_extract(match, VALUE, 0))) \
                    .otherwise(F.length(match))
                ok = F.lit(False)
            else:
                k, start, ok = F.lit(kind), z["e"] - F.length(match), _valid(kind, match)
            return F.struct(start.alias("start"), z["e"].alias("end"), k.alias("kind"), ok.alias("base"),
                            *_votes(k, match, z["l"]["tail"], z["r"]["head"]),
                            F.length(match).alias("length"))
        return F.transform(F.col(d), one)

    empty = "array<struct<start:int,end:int,kind:string,base:boolean," + "".join(
        f"{n}:int," for n in LABELERS) + "length:int>>"
    arrays = [F.coalesce(spans(k, d).cast(empty), F.array().cast(empty)) for k, d in zip(names, f)]
    return zipped.select(*docs.columns, F.concat(*arrays).alias(out))


def _length_class(length):
    return sum((length > b).cast("int") for b in LENGTHS) if isinstance(length, Column) \
        else sum(length > b for b in LENGTHS)


def fit(found: DataFrame, column: str, rounds: int = 50) -> dict:
    """Reliabilities and classifier from all candidates in ``column`` of ``found``: they
    reach the driver as counts of (kind, votes, length class), a table whose size is bounded
    by its key."""
    c = F.col("c")
    counts = (found.select(F.explode(column).alias("c"))
              .groupBy(c["kind"].alias("kind"), *[c[n].alias(n) for n in LABELERS],
                       _length_class(c["length"]).alias("size"))
              .agg(F.count(F.lit(1)).alias("n")).orderBy("kind", *LABELERS, "size").collect())
    if not counts:
        return {"bias": -math.inf, "weights": {}, "reliability": {}}
    kind = np.array([KINDS.index(r["kind"]) for r in counts])
    vote = np.array([[r[n] + 1 for n in LABELERS] for r in counts])
    size = np.array([r["size"] for r in counts])
    n = np.array([r["n"] for r in counts], float)
    true = 1 / (1 + np.exp(-2.0 * (vote - 1).sum(axis=1)))          # start from the vote balance
    for _ in range(rounds):
        prior = np.array([(n * true)[kind == k].sum() + 1 for k in range(len(KINDS))]) / np.array(
            [n[kind == k].sum() + 2 for k in range(len(KINDS))])
        odds = np.log(prior[kind]) - np.log(1 - prior[kind])
        table = np.zeros((len(LABELERS), 2, 3))
        for j in range(len(LABELERS)):
            for v in range(3):
                at = vote[:, j] == v
                table[j, 1, v], table[j, 0, v] = (n * true)[at].sum() + 1, (n * (1 - true))[at].sum() + 1
        table[:, 1, 2] += 1                                         # labelers agree with the truth rather
        table[:, 0, 0] += 1                                         # than with its opposite
        table /= table.sum(axis=2, keepdims=True)
        for j in range(len(LABELERS)):
            odds = odds + np.log(table[j, 1, vote[:, j]] / table[j, 0, vote[:, j]])
        true = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    x = np.column_stack([*[vote[:, j] == v for j in range(len(LABELERS)) for v in (0, 2)],
                         *[kind == k for k in range(len(KINDS))],
                         *[size == s for s in range(len(LENGTHS) + 1)]]).astype(float)
    w, bias, share = np.zeros(x.shape[1]), 0.0, n / n.sum()
    for _ in range(400):                                            # Newton steps would be fewer, not clearer
        miss = share * (1 / (1 + np.exp(-(x @ w + bias))) - true)
        w -= 4.0 * (x.T @ miss + 1e-4 * w)
        bias -= 4.0 * miss.sum()
    names = [*[f"{name}={v}" for name in LABELERS for v in (-1, 1)], *[f"kind={k}" for k in KINDS],
             *[f"size={s}" for s in range(len(LENGTHS) + 1)]]
    return {"bias": float(bias), "weights": dict(zip(names, map(float, w))),
            "reliability": {name: table[j].tolist() for j, name in enumerate(LABELERS)}}


def _accepted(model: dict, c: Column) -> Column:
    """Whether the classifier takes a candidate for personal data (probability over 1/2)."""
    if not model["weights"]:
        return F.lit(False)
    w = model["weights"]
    terms = [F.when(c[n] == v, w[f"{n}={v}"]).otherwise(0.0) for n in LABELERS for v in (-1, 1)]
    terms += [F.when(c["kind"] == k, w[f"kind={k}"]).otherwise(0.0) for k in KINDS]
    terms += [F.when(_length_class(c["length"]) == s, w[f"size={s}"]).otherwise(0.0)
              for s in range(len(LENGTHS) + 1)]
    return reduce(lambda a, b: a + b, terms, F.lit(model["bias"])) > 0


def spans(found: str, model: dict) -> Column:
    """Base spans and accepted candidates apart from them, ordered by start and kind:
    an array of structs of start, rank of the kind, end, kind and base."""
    rank = F.map_from_arrays(F.array(*[F.lit(k) for k in KINDS]), F.array(*[F.lit(i) for i in range(len(KINDS))]))

    def row(c):
        return F.struct(c["start"].alias("start"), F.element_at(rank, c["kind"]).alias("rank"),
                        c["end"].alias("end"), c["kind"].alias("kind"), c["base"].alias("base"))

    def apart(c):
        return ~F.exists(found, lambda b: b["base"] & (b["start"] < c["end"]) & (c["start"] < b["end"]))

    chosen = F.filter(found, lambda c: F.when(c["base"], True).when(_accepted(model, c), apart(c)).otherwise(False))
    return F.array_sort(F.transform(chosen, row))


def joined(rows: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(rows, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, spans)`` of every row; see ``spans`` for the fields."""
    table = materialize(candidates(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")),
                                   "text", "found").select("id", "found"))
    model = fit(table, "found")
    return table.select(F.col("id").alias(id_col), spans("found", model).alias("spans"))


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by its kind in brackets; overlapping
    spans become one replacement after the other without repeating text."""
    at = free_name(docs, "_spans")
    # written once with its candidates: the model is fitted on them all, then they are judged
    marked = materialize(candidates(docs, text_col, at))
    model = fit(marked.where(F.size(at) > 0), at)
    marked = marked.select(*docs.columns, spans(at, model).alias(at))
    text = F.col(text_col)

    def step(s, x):
        before = F.substring(text, s["at"] + 1, F.greatest(x["start"] - s["at"], F.lit(0)))
        return F.when(x["end"] <= s["at"], s).otherwise(F.struct(
            x["end"].alias("at"),
            F.concat(s["out"], F.array(before, F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))).alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    whole = F.aggregate(F.col(at), start, step, lambda s: F.array_join(
        F.concat(s["out"], F.array(F.substring(text, s["at"] + 1, F.length(text)))), ""))
    new = F.when(text.isNull() | (F.size(at) == 0), text).otherwise(whole)
    return marked.select(*[new.alias(c) if c == text_col else F.col(c) for c in docs.columns])
