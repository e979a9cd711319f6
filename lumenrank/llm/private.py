"""Operator 2, personal data by weakly supervised span classification.

1. One pass over the whole texts finds the base spans (email, ip, card,
   phone) and looser candidates of further kinds. Labelers vote on each
   candidate: regular expressions, gazetteers and context words say yes, no
   or nothing. Spans, votes and features are written once, without texts.
2. The counts of vote patterns per kind, a bounded table over all candidates,
   feed an expectation-maximisation that estimates every labeler's
   reliability and the probability of each pattern.
3. These probabilities weight the feature counts of all candidates, from
   which the final naive Bayes span classifier is trained (a bounded table
   again). A further candidate becomes a span when the classifier is sure, a
   labeler spoke for it and no base span overlaps it. Base spans always stay.

Defined results: a null text is empty and has no spans. Rows are handled one
by one, so repeated rows and ids give repeated results; an empty table gives
an empty result. Other columns of ``docs`` are not read. All patterns are
linear in the text, also for very long runs of one kind of character.
"""

from __future__ import annotations

import math
import re
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrank.llm.registry import documents, query
from lumenrank.session import materialise

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("email_text", "phone_local", "ipv6", "iban", "ssn", "person")
KINDS = BASE_KINDS + MORE_KINDS
ORDER = {k: i for i, k in enumerate(KINDS)}

SURE = 0.9  # probability from which a further candidate becomes a span
FEATURE_BUCKETS = 1024
EM_ROUNDS = 50
PSEUDO = 5.0  # weight of the starting reliabilities, in observations

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Frequent given names of the four languages.
GIVEN_NAMES = (
    "James John Robert Michael William David Richard Joseph Thomas Charles Mary Patricia Jennifer Linda Elizabeth Barbara "
    "Susan Jessica Sarah Karen Anna Peter Paul Mark George Edward Emma Olivia Jean Pierre Michel Claude Jacques Nicolas Marie "
    "Nathalie Isabelle Sophie Catherine Camille Hans Klaus Wolfgang Stefan Andreas Uwe Petra Sabine Ursula Monika Heike "
    "Antonio Manuel Carlos Francisco Javier Miguel Jorge Juan Pedro Luis Carmen Dolores Pilar Teresa Ana Lucia Elena"
).split()
# Titles before a name.
TITLES = "Mr Mrs Ms Dr Prof Sir Herr Frau Mme Mlle Monsieur Madame Sr Sra Don".split()
# Words near personal data, and words near other numbers.
NEAR_PRIVATE = frozenset(
    "email e-mail mail contact reach write phone tel telephone call mobile cell fax whatsapp ip address host card visa mastercard "
    "iban account bank ssn social security name named mr mrs ms dr born signed author telefon anrufen handy konto adresse "
    "téléphone appeler courriel compte correo teléfono llamar cuenta dirección".split()
)
NEAR_NUMBERS = frozenset(
    "version page pages isbn issn order total figure fig table price section chapter article vol volume serial model part "
    "id ref invoice date year seite kapitel preis página precio prix numéro".split()
)
# Frequent top-level domains.
DOMAIN_ENDS = frozenset("com org net edu gov io info de fr es uk us eu ch at it nl".split())
# Country codes that begin an account number.
IBAN_COUNTRIES = frozenset("AT BE CH CZ DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split())

_MORE = (
    ("email_text", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\[dot\]|\(dot\)| dot ) ?[A-Za-z0-9-]{1,63}+){1,4}", re.I)),
    ("phone_local", re.compile(r"(?<![0-9+.\w-])\(?[0-9]{2,4}+\)?[ .-][0-9]{3,4}+[ .-][0-9]{3,5}+(?![0-9\w-])")),
    ("ipv6", re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){7}(?![0-9A-Fa-f:])")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("ssn", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("person", re.compile(r"\b(?:(?:%s)\.? [A-ZÀ-ÖØ-Þ][\w'-]{1,30}+(?: [A-ZÀ-ÖØ-Þ][\w'-]{1,30}+)?|(?:%s) [A-ZÀ-ÖØ-Þ][\w'-]{1,30}+)" % ("|".join(TITLES), "|".join(GIVEN_NAMES)))),
)
# What a text must hold for a pattern to be tried.
_HINTS = {"email_text": re.compile(r"[\[( ]at[\]) ]", re.I), "ipv6": re.compile(":[0-9A-Fa-f]{1,4}:")}


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches around every @, which is the only place where one can be."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            found.append((start, end))
        at = text.find("@", end if domain else at + 1)
    return found


def _small(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans ``kind, start, end`` in code points, by start and kind."""
    found = [("email", s, e) for s, e in _emails(text)]
    if _ANY_DIGIT.search(text):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m.groups()))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = _digits(m[0])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", *m.span()))
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(found, key=_place)


_ANY_DIGIT = re.compile("[0-9]")


def _place(span: tuple) -> tuple:
    return span[1], ORDER[span[0]], span[2]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def more_candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of further kinds that overlap no base span."""
    digit = _ANY_DIGIT.search(text) is not None
    found = []
    for kind, pattern in _MORE:
        if kind in ("phone_local", "iban", "ssn", "ipv6") and not digit:
            continue
        if kind in _HINTS and not _HINTS[kind].search(text):
            continue
        found += [(kind, *m.span()) for m in pattern.finditer(text)]
    if taken and found:
        ends, last = [], 0
        for _, _, e in taken:
            last = max(last, e)
            ends.append(last)
        starts = [s for _, s, _ in taken]
        import bisect

        free = []
        for c in found:
            before = bisect.bisect_left(starts, c[2])
            if not before or ends[before - 1] <= c[1]:
                free.append(c)
        found = free
    return found


# Labelers: 1 for personal data, -1 against, 0 no opinion.


def _vote_form(kind: str, body: str, words: list[str]) -> int:
    """Regular expression and checksum of the kind."""
    if kind == "card":
        return 1 if luhn(_digits(body)) else -1
    if kind == "iban":
        flat = body.replace(" ", "")
        turned = "".join(str(int(c, 36)) for c in flat[4:] + flat[:4])
        return 1 if int(turned) % 97 == 1 else -1
    if kind == "ssn":
        return -1 if body[:3] in ("000", "666") or body[0] == "9" or body[4:6] == "00" else 1
    if kind == "email":
        return 1 if re.fullmatch(r"[A-Za-z0-9][^@]*@[^@]+\.[A-Za-z]{2,}", body) else -1
    if kind in ("phone", "phone_local"):
        return 1 if 9 <= len(_digits(body)) <= 13 else -1
    return 0


def _vote_not_number(kind: str, body: str, words: list[str]) -> int:
    """Dates, decimals and ranges look like numbers of persons."""
    if kind in ("phone_local", "card", "ssn"):
        if re.match(r"(?:19|20)[0-9]{2}[ .-][01]?[0-9]", body) or re.match(r"[0-9]+\.[0-9]+\.[0-9]+$", body):
            return -1
    return 0


def _vote_gazetteer(kind: str, body: str, words: list[str]) -> int:
    """Domain endings, account countries, given names."""
    if kind in ("email", "email_text"):
        return 1 if re.split(r"[^A-Za-z0-9-]+", body.lower())[-1] in DOMAIN_ENDS else -1
    if kind == "iban":
        return 1 if body[:2] in IBAN_COUNTRIES else -1
    if kind == "person":
        return 1 if any(w.strip(".") in _NAME_SET for w in body.split()) else 0
    if kind == "card":
        return 1 if body[0] in "3456" else -1
    return 0


_NAME_SET = frozenset(GIVEN_NAMES)


def _vote_context(kind: str, body: str, words: list[str]) -> int:
    """Words before the span that announce personal data."""
    return 1 if any(w in NEAR_PRIVATE for w in words) else 0


def _vote_other_context(kind: str, body: str, words: list[str]) -> int:
    """Words before the span that announce another number."""
    return -1 if any(w in NEAR_NUMBERS for w in words) else 0


def _vote_reserved(kind: str, body: str, words: list[str]) -> int:
    """Addresses that belong to nobody."""
    if kind == "ip":
        return -1 if body.split(".")[0] in ("0", "10", "127", "192", "255") else 1
    if kind == "ipv6":
        return -1 if body.lower().startswith(("fe80", "0:0")) else 1
    return 0


LABELERS = (_vote_form, _vote_not_number, _vote_gazetteer, _vote_context, _vote_other_context, _vote_reserved)


def labelled(text: str, span: tuple[str, int, int]) -> dict:
    """Votes and features of a candidate."""
    kind, start, end = span
    body = text[start:end]
    before = re.findall(r"[^\W\d_][\w-]*", text[max(0, start - 40) : start].lower())[-4:]
    votes = "".join("n0y"[f(kind, body, before) + 1] for f in LABELERS)
    shape = re.sub("[0-9]+", "9", re.sub("[A-ZÀ-ÖØ-Þ]", "A", re.sub(r"[^\W\d_A-ZÀ-ÖØ-Þ]+", "a", body)))[:24]
    raw = [f"shape {shape}", f"length {(end - start) // 4}", f"digits {len(_digits(body))}"]
    raw += [f"before {w}" for w in before[-2:]]
    raw.append(f"after {text[end : end + 1]}")
    features = sorted({zlib.crc32(f"{kind} {f}".encode("utf-8", "replace")) % FEATURE_BUCKETS for f in raw})
    return {"kind": kind, "start": start, "end": end, "votes": votes, "features": features}


_FOUND = "array<struct<kind:string,start:bigint,end:bigint,votes:string,features:array<int>>>"


def find_candidates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, base, found``: base spans as one string, and every candidate with votes and features."""
    import pyarrow as pa

    item = pa.struct(
        [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("votes", pa.string()), ("features", pa.list_(pa.int32()))]
    )

    def run(table):
        for batch in table:
            bases, founds = [], []
            for value in batch.column(1):
                body = value.as_py() or ""
                base = base_spans(body)
                bases.append(joined(base))
                founds.append([labelled(body, c) for c in base + more_candidates(body, base)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(bases, pa.string()), pa.array(founds, pa.list_(item))],
                names=["doc_id", "base", "found"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, base string, found {_FOUND}")


def estimate(patterns: dict[tuple[str, str], int], rounds: int = EM_ROUNDS) -> dict[tuple[str, str], float]:
    """Probability that a candidate of a kind with a vote pattern is personal data.

    Two classes per kind; given the class the labelers vote independently.
    A labeler starts as right four times of five when it speaks, and keeps
    ``PSEUDO`` observations of that belief, so rare kinds stay near it.
    """
    result = {}
    for kind in sorted({k for k, _ in patterns}):
        own = {v: n for (k, v), n in patterns.items() if k == kind}
        total, m = sum(own.values()), len(LABELERS)
        start = {1: {"y": 0.48, "n": 0.12, "0": 0.4}, 0: {"y": 0.12, "n": 0.48, "0": 0.4}}
        prior, table = 0.5, [{y: dict(start[y]) for y in (0, 1)} for _ in range(m)]
        chance: dict[str, float] = {}
        for _ in range(rounds):
            for votes in own:
                odds = math.log(prior / (1 - prior)) + sum(
                    math.log(table[j][1][v] / table[j][0][v]) for j, v in enumerate(votes)
                )
                chance[votes] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
            prior = (PSEUDO / 2 + sum(n * chance[v] for v, n in own.items())) / (PSEUDO + total)
            for j in range(m):
                for y in (0, 1):
                    seen = {v: PSEUDO * start[y][v] for v in "yn0"}
                    for votes, n in own.items():
                        seen[votes[j]] += n * (chance[votes] if y else 1 - chance[votes])
                    table[j][y] = {v: c / sum(seen.values()) for v, c in seen.items()}
        result.update({(kind, v): p for v, p in chance.items()})
    return result


def train(found: DataFrame, chance: dict[tuple[str, str], float]) -> dict[tuple[str, int], float]:
    """Log-odds weights of the naive Bayes classifier: (kind, feature) and (kind, -1) for the kind alone."""
    spark = found.sparkSession
    soft = spark.createDataFrame([(k, v, p) for (k, v), p in chance.items()], "kind string, votes string, p double")
    each = found.select("kind", "votes", F.explode(F.concat(F.array(F.lit(-1)), "features")).alias("feature"))
    counted = each.groupBy("kind", "votes", "feature").agg(F.count(F.lit(1)).alias("n"))
    sums = counted.join(soft, ["kind", "votes"]).groupBy("kind", "feature").agg(
        F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum(F.col("n") * (1 - F.col("p"))).alias("no")
    )
    rows = {(r["kind"], r["feature"]): (r["yes"], r["no"]) for r in sums.collect()}  # kinds x buckets at most
    weights = {}
    for (kind, feature), (yes, no) in rows.items():
        all_yes, all_no = rows[kind, -1]
        if feature < 0:
            weights[kind, feature] = math.log((all_yes + 0.5) / (all_no + 0.5))
        else:
            weights[kind, feature] = math.log((yes + 0.5) / (all_yes + 1.0)) - math.log((no + 0.5) / (all_no + 1.0))
    return weights


def find_private(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", sure: float = SURE
) -> DataFrame:
    """``doc_id``, counts of base spans, ``base`` and ``spans`` for every row."""
    import pyarrow as pa

    marked = materialise(find_candidates(docs, id_col, text), "candidates")
    found = marked.select(F.explode("found").alias("f")).select("f.*")
    patterns = {(r["kind"], r["votes"]): r["count"] for r in found.groupBy("kind", "votes").count().collect()}
    weights = train(found, estimate(patterns)) if patterns else {}

    def run(table):
        for batch in table:
            rows = []
            for base, items in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                spans = []
                for x in items or []:
                    if x["kind"] in BASE_KINDS:
                        spans.append((x["kind"], x["start"], x["end"]))
                        continue
                    odds = weights.get((x["kind"], -1), 0.0) + sum(weights.get((x["kind"], f), 0.0) for f in x["features"])
                    if "y" in x["votes"] and 1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))) >= sure:
                        spans.append((x["kind"], x["start"], x["end"]))
                counts = [sum(s[0] == k for s in spans) for k in BASE_KINDS]
                rows.append((*counts, base, joined(sorted(spans, key=_place))))
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:4]], *[pa.array(c, pa.string()) for c in columns[4:]]],
                names=["doc_id", *[f"n_{k}" for k in BASE_KINDS], "base", "spans"],
            )

    kind = marked.schema["doc_id"].dataType.simpleString()
    return marked.mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


@query()
def op2_private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_private(documents(spark, sf_dir))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base"), 256).alias("base_sha256"), "spans"
    )
