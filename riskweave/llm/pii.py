"""Personal data in texts by weak supervision, in DataFrame functions only.

Candidates are the spans of four strict patterns (the base: e-mail, IP address, card and phone numbers, with their checks) and of
looser ones (written-out addresses, IPv6, cards with other separators or a wrong check digit, phones without a plus).
Labelers vote on each candidate for, against or not at all: its pattern and checks, gazetteers (top-level domains,
card issuers, calling codes, reserved networks), the words before it, and its shape. Expectation-maximisation over
the counts of vote patterns estimates how reliable each labeler is for each kind, and so how likely each candidate is
real. A logistic regression on votes, kind, length and hashed context (the words and shapes around a candidate and its own shape)
learns those probabilities from a bounded sample of candidates and decides: base spans stay, other candidates that it gives
``threshold`` or more are added, unless they overlap a base span of their kind.

Texts are read once; candidates (not texts) are written to the shared folder. Counts of vote patterns, bounded by the labelers,
and the sample (``per_kind`` strict and loose candidates a kind) come to the driver. Times are near linear in a text's length.

Defined results: null text is empty; a text without candidates has zero counts and ''; repeated rows are searched
each; an empty table gives no rows. Offsets are code points from 0, ends exclusive.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import docs_of, row_draws, write_shared
from riskweave.llm.winnowing import let

KINDS = ("email", "ip", "card", "phone")
VOTES = ("pattern", "gazetteer", "context", "shape")
HASHED = 4096  # weights that hashed context shares

#: The strict patterns. Lookbehinds and possessive repeats only spare retries: the matches are those of the plain forms
#: [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+, [0-9]+(\.[0-9]+){3}, [0-9]([\x20-]?[0-9])+, \+[0-9][\x20().0-9-]+[0-9].
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}(?:\x20?(?:\(at\)|\[at\]|\{at\})\x20?[a-z0-9-]{1,63}(?:(?:\.|\x20?(?:\(dot\)|\[dot\]|\{dot\})\x20?|\x20dot\x20)"
             r"[a-z0-9-]{2,63})+|\x20at\x20[a-z0-9-]{1,63}(?:\x20dot\x20[a-z0-9-]{2,63})+)(?![a-z0-9-])",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z.,+-])[0-9]{4}(?:[\x20./_-]{0,3}[0-9]{4}){2}[\x20./_-]{0,3}[0-9]{3,4}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z.,+(/-])(?:\([0-9]{2,5}\)|00?[1-9][0-9]{0,3}|[2-9][0-9]{2})(?:[\x20./-]{1,2}[0-9]{2,5}){2,4}(?![0-9A-Za-z])",
}
TOP_LEVEL = ("com org net edu gov mil int info biz io co me app dev ai eu us uk de fr es it nl be ch at pl se no dk fi pt gr ie cz ru ua tr in cn jp kr "
             "br mx ar au nz ca za example test local").split()
#: Calling codes by first digits; one and seven stand alone, others have two or three digits.
CALLING = r"^(?:1|7|2[07]|2[1-69][0-9]|3[0-469]|3[578][0-9]|4[013-9]|42[0-9]|5[1-8]|5[09][0-9]|6[0-6]|6[789][0-9]|8[1246]|8[0578][0-9]|9[0-58]|9[679][0-9])"
ISSUER = r"^(?:4[0-9]{12}(?:[0-9]{3}){0,2}|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|3[0689][0-9]{12}|6(?:011|5[0-9]{2}|4[4-9][0-9])[0-9]{12}|35[0-9]{14}|62[0-9]{14,17})$"
RESERVED = r"^(?:0+|10|127|192\.168|169\.254|172\.(?:1[6-9]|2[0-9]|3[01])|255|22[4-9]|2[34][0-9])\."
FOR = {
    "email": r"(?:e-?mail|mail|contact|kontakt|correo|courriel|write to|reach|address)\W*$",
    "ip": r"(?:\bip\b|ipv[46]|address|adresse|server|host|client|from|login|dirección)\W*$",
    "card": r"(?:card|visa|master|amex|credit|debit|karte|tarjeta|carte|payment)\W*(?:no|nr|number|nummer)?\W*$",
    "phone": r"(?:tel|phone|call|mobile|cell|fax|telefon|handy|téléphone|teléfono|móvil|whatsapp|contact)\W*(?:no|nr|number|nummer)?\W*$",
}
AGAINST = r"(?:version|\bv|isbn|issn|order|invoice|serial|ticket|article|part|section|chapter|build|release|port|doi|page|id)\W*(?:no|nr|number)?\W*$"


SPAN = "array<struct<start:int,end:int,match:string>>"


def found(text: Column, pattern: str) -> Column:
    """(start, end, match) of all matches, in code points: lengths of the pieces between and of the matches add up.

    Matches are walked in runs of the root of their number: first the runs' lengths, then each run from its start, so that no
    long array is copied for every match."""

    def runs(matches: Column, pieces: Column, n: Column, run: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((n - 1) / run).cast("int"))
        of = lambda c: F.sequence(c * run, F.least((c + 1) * run, n) - 1)
        long = lambda i: F.length(F.get(pieces, i)) + F.length(F.get(matches, i))
        sums = F.transform(numbers, lambda c: F.aggregate(of(c), F.lit(0), lambda a, i: a + long(i)))
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        begins = F.aggregate(sums, none, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

        def step(s: Column, i: Column) -> Column:
            begin = s["at"] + F.length(F.get(pieces, i))
            end = begin + F.length(F.get(matches, i))
            return F.struct(end.alias("at"), F.concat(s["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), F.get(matches, i).alias("match")))).alias("out"))

        walk = lambda at, c: F.aggregate(of(c), F.struct(at.alias("at"), F.array().cast(SPAN).alias("out")), step, lambda s: s["out"])
        return F.flatten(F.transform(begins, walk))

    sized = lambda m, p: let(F.size(m), lambda n: let(F.ceil(F.sqrt(n)).cast("int"), lambda run: runs(m, p, n, run)))
    all_of = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: let(F.split(text, pattern, -1), lambda p: sized(m, p)))
    return F.when(F.regexp_like(text, F.lit(pattern)), all_of).otherwise(F.array().cast(SPAN))


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    places = F.sequence(F.lit(1), F.greatest(F.length(number), F.lit(1)))  # from the last digit
    value = lambda i: let(F.substring(number, -i, F.lit(1)).cast("int"), lambda d: F.when(i % 2 == 1, d).otherwise(doubled(d)))
    return F.aggregate(F.transform(places, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(kind: str, m: Column) -> Column:
    n = F.length(digits(m))
    if kind == "ip":
        return ~F.exists(F.split(m, r"\."), lambda p: ~F.regexp_like(p, F.lit(r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})$")))
    if kind == "card":
        return n.between(12, 19) & F.when(n.between(12, 19), luhn(digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def votes(kind: str, s: Column, before: Column, base: bool) -> list[Column]:
    """Votes of the labelers on one candidate, ``before`` its text's 24 code points before it: 1, -1 or 0."""
    m = s["match"]
    num = digits(m)
    sign = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    never = F.lit(False)
    if base:
        pattern = F.lit(1)
    else:
        pattern = {"card": sign(never, ~luhn(num)), "phone": sign(never, ~F.length(num).between(9, 15))}.get(kind, F.lit(0))
    if kind == "email":
        tld = F.lower(F.regexp_extract(m, r"([A-Za-z0-9-]+)$", 1))
        gazetteer = sign(tld.isin(TOP_LEVEL), F.regexp_like(tld, F.lit("^[0-9]+$")))
        shape = sign(never, F.length(m) > 128)
    elif kind == "ip":
        gazetteer = sign(~F.regexp_like(m, F.lit(RESERVED)), F.regexp_like(m, F.lit(RESERVED)))
        shape = sign(F.regexp_like(m, F.lit(r"^[1-9][0-9]*(?:\.(?:0|[1-9][0-9]*)){3}$|:")), F.regexp_like(m, F.lit(r"(?:^|\.)0[0-9]")))
    elif kind == "card":
        gazetteer = sign(F.regexp_like(num, F.lit(ISSUER)), F.regexp_like(num, F.lit("^[0789]")))
        shape = sign(F.regexp_like(m, F.lit(r"^(?:[0-9]+|[0-9]{4}(?:([\x20-])[0-9]{4})(?:\1[0-9]{1,4})+)$")), F.regexp_like(num, F.lit(r"^([0-9])\1+$")))
    else:
        plus = F.regexp_like(m, F.lit(r"^(?:\+|00)"))
        gazetteer = sign(plus & F.regexp_like(F.regexp_replace(num, "^00", ""), F.lit(CALLING)), plus)
        shape = sign(F.regexp_like(m, F.lit(r"^[^()]*(?:\([0-9]{1,5}\)[^()]*)?$")), F.regexp_like(num, F.lit(r"^([0-9])\1+$")) | F.regexp_like(m, F.lit(r"\([^)]*$")))
    context = sign(F.regexp_like(before, F.lit(FOR[kind])), F.regexp_like(before, F.lit(AGAINST)))
    return [x.cast("int") for x in (pattern, gazetteer, context, shape)]


def shape_of(char: Column) -> Column:
    return F.when(F.regexp_like(char, F.lit(r"\p{L}")), F.lit("L")).when(F.regexp_like(char, F.lit(r"\p{N}")), F.lit("N")).when(F.regexp_like(char, F.lit(r"\s")), F.lit("S")).otherwise(char)


def context(kind: str, s: Column, before: Column, after: Column) -> Column:
    """Hashed features of a candidate: the two words before it, the word after, the shapes of its neighbours and its own."""
    own = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.substring(s["match"], 1, 40), r"\p{L}+", "L"), r"[0-9]+", "N"), r"\s", "S")
    named = {"b1": F.regexp_extract(before, r"(\p{L}+)\P{L}*$", 1), "b2": F.regexp_extract(before, r"(\p{L}+)\P{L}+\p{L}+\P{L}*$", 1),
             "a1": F.regexp_extract(after, r"^\P{L}*(\p{L}+)", 1), "bs": shape_of(F.substring(before, -1, 1)), "as": shape_of(F.substring(after, 1, 1)), "own": own}
    return F.array(*[F.pmod(F.xxhash64(F.lit(f"{kind}:{name}"), value), F.lit(HASHED)).cast("int") for name, value in named.items()])


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, spans: array of (start, kind's number, end, base, votes, length class, hashed context), by start."""
    rows = docs_of(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    could = F.regexp_like("text", F.lit(r"[0-9@]|(?i)[(\[{]at[)\]}]|\x20dot\x20|:[0-9A-Fa-f]"))
    struct_type = "array<struct<start:int,kind:int,end:int,base:boolean,votes:array<int>,size:int,context:array<int>>>"

    def described(kind: str, spans: Column, base: bool) -> Column:
        size = lambda s: F.least(((s["end"] - s["start"]) / 6).cast("int"), F.lit(7))
        # Neighbours are cut from the text's UTF-32, where a place is reached without reading what lies before it.
        part = lambda code, at, n: F.lower(F.decode(F.substring(code, at * 4 + 1, n * 4), "UTF-32"))

        def one(s: Column, before: Column, after: Column) -> Column:
            return F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end"), F.lit(base).alias("base"),
                            F.array(*votes(kind, s, before, base)).alias("votes"), size(s).alias("size"), context(kind, s, before, after).alias("context"))

        beside = lambda code, s: let(part(code, F.greatest(s["start"] - 24, F.lit(0)), F.least(s["start"], F.lit(24))),
                                     lambda before: let(part(code, s["end"], F.lit(24)), lambda after: one(s, before, after)))
        return F.when(F.size(spans) > 0, let(F.encode("text", "UTF-32"), lambda code: F.transform(spans, lambda s: beside(code, s))))

    for kind in KINDS:
        rows = rows.withColumn(f"s_{kind}", F.when(could, _passing(kind, found(F.col("text"), STRICT[kind]))))
        rows = rows.withColumn(f"l_{kind}", F.when(could, found(F.col("text"), LOOSE[kind])))
    loosely = lambda kind: lambda spans: described(kind, spans, False)
    arrays = []
    for kind in KINDS:
        # A loose span that meets a strict one, of its own kind or of one listed before, is that one seen otherwise.
        loose = F.col(f"l_{kind}")
        for other in KINDS[:KINDS.index(kind) + 1]:
            loose = _apart(loose, F.col(f"s_{other}"))
        arrays += [described(kind, F.col(f"s_{kind}"), True), let(loose, loosely(kind))]
    none = F.array().cast(struct_type)
    return rows.select("doc_id", F.coalesce(F.when(could, F.array_sort(F.concat(*[F.coalesce(a.cast(struct_type), none) for a in arrays]))), none).alias("spans"))


def _passing(kind: str, spans: Column) -> Column:
    return F.filter(spans, lambda s: passes(kind, s["match"]))


def _apart(spans: Column, others: Column) -> Column:
    """The spans that meet none of the others, which are in order and apart: the last that starts before a span's end decides."""

    def before(o: Column, end: Column) -> Column:
        """How many of the others start before ``end``, by halving."""
        half = lambda r: F.floor((r["lo"] + r["hi"]) / 2).cast("int")
        ranged = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
        step = lambda r, _: F.when(r["lo"] >= r["hi"], r).when(F.get(o, half(r))["start"] < end, ranged(half(r) + 1, r["hi"])).otherwise(ranged(r["lo"], half(r)))
        steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(o) + 1)).cast("int"))
        return F.aggregate(steps, ranged(F.lit(0), F.size(o)), step, lambda r: r["lo"])

    many = lambda o: F.filter(spans, lambda s: ~F.coalesce(F.get(o, before(o, s["end"]) - 1)["end"] > s["start"], F.lit(False)))
    few = F.filter(spans, lambda s: ~F.exists(others, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return F.when(F.size(others) <= 16, few).otherwise(let(others, many))


def estimate(counts: dict[tuple, int], rounds: int = 50) -> dict[tuple, float]:
    """P(real) of every (kind, votes) pattern by expectation-maximisation.

    Each labeler has, for each kind, a chance to be right when it votes; abstaining says nothing. The share of real ones
    is that of strict or of loose candidates. Pseudo-counts keep rare kinds near their prior: 0.8 (0.95 for checks) for a
    labeler, half of strict and a fifth of loose candidates. Checks stay at 0.95 or more: a real number never fails its check digit. A loose
    pattern by itself says nothing, so its share stays at one half or less: else many lookalikes would vouch for each other."""
    kinds = {k for k, _ in counts}
    prior = {j: (95, 100) if name == "pattern" else (8, 10) for j, name in enumerate(VOTES)}
    right = {(k, j): prior[j][0] / prior[j][1] for k in kinds for j in prior}
    share = {(k, strict): 0.5 if strict else 0.2 for k in kinds for strict in (True, False)}
    post: dict[tuple, float] = {}
    for _ in range(rounds):
        for (k, v) in counts:
            odds = math.log(share[k, v[0] > 0] / (1 - share[k, v[0] > 0])) + sum(x * math.log(right[k, j] / (1 - right[k, j])) for j, x in enumerate(v))
            post[k, v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        for k in kinds:
            mine = [(v, c, post[k, v]) for (kk, v), c in counts.items() if kk == k]
            for strict in (True, False):
                some = [(c, p) for v, c, p in mine if (v[0] > 0) == strict]
                share[k, strict] = min(0.99 if strict else 0.5, max(0.01, ((5 if strict else 2) + sum(c * p for c, p in some)) / (10 + sum(c for c, _ in some))))
            for j in range(len(VOTES)):
                agree = sum(c * (p if v[j] > 0 else 1 - p) for v, c, p in mine if v[j])
                cast = sum(c for v, c, _ in mine if v[j])
                right[k, j] = min(0.99, max(0.95 if VOTES[j] == "pattern" else 0.5, (prior[j][0] + agree) / (prior[j][1] + cast)))
    return post


def places(kind, base, size, vote: list, hashed: list) -> list:
    """Where a candidate's features stand in the table of weights: kind, strictness, length class and votes, then hashed context.

    For numbers and for Columns alike."""
    return [kind, kind * 2 + base + 4, kind * 8 + size + 12, *((kind * 4 + j) * 3 + x + 45 for j, x in enumerate(vote)), *(x + 92 for x in hashed)]


def train(rows: list[tuple[list[int], float]], steps: int = 200, l2: float = 2e-3) -> np.ndarray:
    """Logistic regression of P(real) on the candidates' features, by full gradient steps scaled per feature."""
    w = np.zeros(92 + HASHED)
    if not rows:
        return w
    row = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows])
    col = np.concatenate([np.array(f) for f, _ in rows])
    goal, total = np.array([p for _, p in rows]), np.full_like(w, 1e-8)
    for _ in range(steps):
        off = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col], len(rows)), -30, 30))) - goal
        g = np.bincount(col, off[row], len(w)) / len(rows) + l2 * w
        total += g * g
        w -= 0.3 * g / np.sqrt(total)
    return w


def search(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, per_kind: int = 2000) -> DataFrame:
    """Per document: spans, an array of (start, end, kind, base, probability) by start, then kind.

    The classifier is fitted on about ``per_kind`` strict and as many loose candidates of each kind, drawn by row."""
    rows, _ = write_shared(candidates(docs, id_col, text_col), "candidates")
    each = rows.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")
    cells = each.groupBy("kind", "base", "votes").count().collect()  # bounded: kinds x votes
    by_vote: dict[tuple, int] = defaultdict(int)
    sums: dict[tuple, int] = defaultdict(int)
    for r in cells:
        by_vote[r.kind, tuple(r.votes)] += r["count"]
        sums[r.kind, r.base] += r["count"]
    post = estimate(by_vote)
    share = F.lit(0.0)
    for (kind, base), n in sums.items():
        share = F.when((F.col("kind") == kind) & (F.col("base") == base), F.lit(min(1.0, per_kind / n))).otherwise(share)
    drawn = row_draws(each, "doc_id", "start", "kind").where(F.col("_draw") < share).select("kind", "base", "votes", "size", "context").collect() if cells else []
    drawn = sorted((r.kind, r.base, r["size"], tuple(r.votes), tuple(r.context)) for r in drawn)
    weights = train([(places(k, int(base), size, v, c), post[k, v]) for k, base, size, v, c in drawn])
    table = F.split(F.lit(",".join(repr(float(x)) for x in weights)), ",").cast("array<double>")

    def weigh(w: Column, s: Column) -> Column:
        fixed = places(s["kind"], s["base"].cast("int"), s["size"], [s["votes"][j] for j in range(len(VOTES))], [])
        hashed = F.aggregate(s["context"], F.lit(0.0), lambda a, x: a + F.get(w, x + 92))
        return 1 / (1 + F.exp(-sum((F.get(w, i) for i in fixed), hashed)))

    names = F.array(*[F.lit(k) for k in KINDS])
    scored = let(table, lambda w: F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("order"), s["end"].alias("end"), F.get(names, s["kind"]).alias("kind"),
                                                                          s["base"].alias("base"), weigh(w, s).alias("probability"))))
    return rows.select("doc_id", F.filter(scored, lambda s: s["base"] | (s["probability"] >= threshold)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
