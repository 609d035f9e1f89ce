"""Personal data by weak supervision.

Loose patterns propose spans of each kind in whole texts. Six labelers vote on each: its form, its
check, lists of known prefixes and endings, the words before it, its borders, its shape.
Expectation maximisation over the counts of vote patterns estimates how reliable each labeler is
for each kind, and with that how likely each pattern is personal data. A logistic classifier
learns these chances from features of the spans and decides on spans beyond the base ones.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweir.llm.common import stored

KINDS = ("email", "ip", "card", "phone")
LABELERS, FEATURES = 6, 10
ACCEPTED = 0.9  # least chance of a span that is added
ROUNDS = 60  # of expectation maximisation
RIGHT, WRONG = 8.0, 2.0  # votes of every labeler, right and wrong, that are taken as seen before
CUES_BEFORE = 40  # code points before a span that are searched for cue words

# The base patterns. Possessive repeats and the look-behind match the same text as
# the plain patterns do, in linear time.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Spans that the base patterns don't have.
SPELLED_MAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]|\{at\}|<at>| at |＠) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\(dot\)|\[dot\]|\{dot\}|<dot>| dot |\.) ?[A-Za-z0-9-]{1,63}+){1,8}", re.I)
DEFANGED_IP = re.compile(r"(?<![0-9])[0-9]{1,3}+(?: ?(?:\[\.\]|\(\.\)|\{\.\}|\[dot\]|\(dot\)| dot ) ?[0-9]{1,3}+){3}", re.I)
IP6 = re.compile(r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}+:){2,7}+(?::?[0-9A-Fa-f]{1,4}+)(?::[0-9A-Fa-f]{1,4}+){0,6}(?![0-9A-Fa-f:])")
SPACED_CARD = re.compile(r"(?<![0-9])[0-9]{4}+(?:[ ./_  ‑–-]{1,3}[0-9]{2,6}+){2,4}(?![0-9])")
HOME_PHONE = re.compile(r"(?<![0-9+(])(?:00[1-9][0-9]{0,2}+[ ./-]?)?\(?0?[0-9]{2,4}+\)?[ ./-][0-9]{3,4}+[ ./-][0-9]{3,5}+(?:[ ./-][0-9]{2,4}+)?(?![0-9])")

NORTH_AMERICAN = re.compile(r"\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])")

# Endings of domains, prefixes of card numbers with their lengths, calling codes.
ENDINGS = frozenset("com org net edu gov mil int info biz io dev app ai co uk de fr es it nl be ch at pl pt se no dk fi ie eu ru ua cz gr tr jp cn kr in au nz ca us mx br ar cl za".split())
CARD_PREFIXES = (("4", (13, 16, 19)), ("5[1-5]", (16,)), ("2(22[1-9]|2[3-9]|[3-6]|7[01]|720)", (16,)), ("3[47]", (15,)), ("6011|65|64[4-9]", (16, 19)), ("35(2[89]|[3-8])", (16, 17, 18, 19)), ("3(0[0-5]|[689])", (14, 16, 19)), ("62", (16, 17, 18, 19)))
CARD_PREFIXES = tuple((re.compile(p), n) for p, n in CARD_PREFIXES)
CALLING = re.compile("1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[1-368]|2[2-6][0-9]|29[017-9]|35[0-9]|37[0-8]|38[0-35-79]|42[013]|50[0-9]|59[0-9]|67[02-9]|68[0-35-9]|69[0-2]|85[02356]|88[06]|96[0-8]|97[0-7]|99[2-68]")

# Words that speak for a kind, and words that speak against personal data.
FOR = {
    "email": "e-?mail|mail|contact|kontakt|correo|courriel|write|reach",
    "ip": "ip|ipv4|ipv6|host|server|address|adresse|dirección|client|login|from",
    "card": "card|visa|mastercard|amex|credit|debit|karte|kreditkarte|tarjeta|carte|payment|paid",
    "phone": "tel|phone|telefon|teléfono|téléphone|call|mobile|handy|móvil|fax|whatsapp|sms",
}
FOR = {k: re.compile(rf"(?<!\w)(?:{w})(?!\w)", re.I) for k, w in FOR.items()}
AGAINST = re.compile(r"(?<!\w)(?:version|v|release|token|sha|sha1|sha256|md5|hash|key|id|uuid|isbn|issn|doi|order|serial|invoice|rev|section|chapter|build|lot)(?!\w)", re.I)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _is_card(digits: str) -> bool:
    return 13 <= len(digits) <= 19 and luhn(digits)


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def emails(text: str):
    """Matches of the base pattern: every @ with the local part that ends there."""
    done, at = 0, text.find("@")
    while at >= 0:
        local = at
        while local > done and (text[local - 1].isascii() and text[local - 1].isalnum() or text[local - 1] in "._%+-"):
            local -= 1
        match = DOMAIN.match(text, at + 1) if local < at else None
        if match:
            done = match.end()
            yield local, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each kind by the base patterns, and behind them those that fail their check."""
    good: list[list[tuple[int, int]]] = [[] for _ in KINDS]
    bad: list[list[tuple[int, int]]] = [[] for _ in KINDS]
    good[0] = list(emails(text))
    for m in IP.finditer(text):
        (good if all(map(_octet, m[0].split("."))) else bad)[1].append(m.span())
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            (good if _is_card(_digits(m[0])) else bad)[2].append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            (good if 9 <= len(_digits(m[0])) <= 15 else bad)[3].append(m.span())
    return good + bad


def cards_within(text: str, start: int, end: int):
    """Groups of digits within a run that failed, next to each other, that make a card number."""
    groups = [(start + m.start(), start + m.end()) for m in re.finditer("[0-9]+", text[start:end])]
    if len(groups) > 1:
        for i, (s, _) in enumerate(groups):
            digits = ""
            for g, e in groups[i:]:
                digits += text[g:e]
                if len(digits) > 19:
                    break
                if _is_card(digits):
                    yield s, e
                    break


def phone_within(text: str, start: int, end: int):
    """The number at the head of a run that failed because more digits follow it."""
    m = NORTH_AMERICAN.match(text, start, end)
    if m:
        yield m.span()
        return
    digits = 0
    for g in re.finditer("[0-9]+", text[start:end]):
        digits += len(g[0])
        if digits >= 9:
            if digits <= 15 and text[start + 1] != "1":
                yield start, start + g.end()
            return


def more_spans(text: str, taken: list[tuple[int, int]], failed: list[list[tuple[int, int]]]) -> list[list[tuple[int, int]]]:
    """Spans of each kind by the loose patterns, and those within spans that failed their check,
    as far as they touch no base span."""
    taken = sorted(taken)
    starts = [s for s, _ in taken]
    reach, furthest = [], 0
    for _, e in taken:
        furthest = max(furthest, e)
        reach.append(furthest)

    def free(s: int, e: int) -> bool:
        k = bisect_right(starts, e - 1)
        return k == 0 or reach[k - 1] <= s

    out: list[list[tuple[int, int]]] = [[] for _ in KINDS]
    lower = text.lower() if not text.isascii() else text.casefold()
    if ("at" in lower or "＠" in lower) and ("dot" in lower or "at)" in lower or "at]" in lower or "at}" in lower or "at>" in lower or "＠" in lower):
        out[0] = [m.span() for m in SPELLED_MAIL.finditer(text) if free(*m.span())]
    for pattern in (DEFANGED_IP, IP6):
        out[1] += [m.span() for m in pattern.finditer(text) if free(*m.span())]
    out[2] = [m.span() for m in SPACED_CARD.finditer(text) if free(*m.span()) and 13 <= len(_digits(m[0])) <= 19]
    out[2] += [x for span in failed[2] for x in cards_within(text, *span) if free(*x)]
    out[3] = [x for span in failed[3] for x in phone_within(text, *span) if free(*x)]
    out[3] += [m.span() for m in HOME_PHONE.finditer(text) if free(*m.span()) and 9 <= len(_digits(m[0])) <= 15]
    return out


def judged(text: str, kind: int, start: int, end: int, strict: bool) -> tuple[tuple[int, ...], int, bool]:
    """Votes of the labelers (-1, 0, 1), feature bits and whether the check allows the span."""
    span, digits = text[start:end], _digits(text[start:end])
    if kind == 0:
        labels = [x for x in re.split(r"[^A-Za-z0-9-]+", re.sub(r"[({\[<]dot[)}\]>]| dot ", ".", span, flags=re.I)) if x]
        known, check = labels[-1].lower() in ENDINGS, None
        shape = all(len(x) <= 63 for x in labels) and len(span) <= 254
    elif kind == 1:
        parts = re.split(r"[^0-9]+", span) if ":" not in span else []
        check = all(map(_octet, parts)) if parts else span.count(":") == 7 or span.count("::") == 1
        known = bool(parts) and check and 0 < int(parts[0][-3:]) < 224 and int(parts[0][-3:]) != 127
        shape = len(parts) == 4 and len(span) >= 9 or bool(not parts and any(len(x) > 2 for x in span.split(":")))
    elif kind == 2:
        check = _is_card(digits)
        known = any(p.match(digits) and len(digits) in n for p, n in CARD_PREFIXES)
        groups = [len(g) for g in re.findall("[0-9]+", span)]
        shape = len(groups) == 1 or groups in ([4] * 4, [4, 6, 5], [4, 6, 4], [4] * 4 + [3])
    else:
        check = 9 <= len(digits) <= 15
        known = bool(CALLING.match(digits[2:] if digits.startswith("00") else digits)) and (span[0] == "+" or digits.startswith("00"))
        groups = re.findall("[0-9]+", span)
        shape = all(len(g) <= 4 for g in groups[1:]) or len(groups) == 1
    before = text[max(0, start - CUES_BEFORE) : start]
    left = start == 0 or not (text[start - 1].isalnum() or text[start - 1] in "_/=")
    right = end == len(text) or not (text[end].isalnum() or text[end] in "_/=")
    cue, counter = bool(FOR[KINDS[kind]].search(before)), bool(AGAINST.search(before))
    vote = lambda x: 1 if x else -1
    votes = (vote(strict), 0 if check is None else vote(check), vote(known) if kind != 1 or ":" not in span else 0, cue - counter, vote(left and right), vote(shape))
    bits = (strict, check is not False, left, right, cue, counter, known, any(c.isalpha() for c in span), any(c in "([{<" for c in span), len(digits) >= 9)
    return votes, sum(b << k for k, b in enumerate(bits)), check is not False


def _code(votes: tuple[int, ...]) -> int:
    return sum((v + 1) * 3**k for k, v in enumerate(votes))


SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("votes", pa.int32()), ("bits", pa.int32()), ("base", pa.bool_()), ("valid", pa.bool_())])
SPAN_DDL = "array<struct<kind:int,start:int,end:int,votes:int,bits:int,base:boolean,valid:boolean>>"
ANY = re.compile("[0-9@＠]|::|dot", re.I)


def found(text: str | None) -> list[dict]:
    """Every span that is proposed in a text, with its votes and features."""
    if not text or not ANY.search(text):
        return []
    sorts = base_spans(text)
    good, bad = sorts[: len(KINDS)], sorts[len(KINDS) :]
    loose = more_spans(text, [s for spans in good for s in spans], bad)
    out = []
    for kind in range(len(KINDS)):
        seen = set()
        for spans, base, strict in ((good[kind], True, True), (bad[kind], False, True), (loose[kind], False, False)):
            for start, end in spans:
                if (start, end) not in seen:
                    votes, bits, valid = judged(text, kind, start, end, strict)
                    out.append({"kind": kind, "start": start, "end": end, "votes": _code(votes), "bits": bits, "base": base, "valid": valid})
                    seen.add((start, end))
    return out


def propose(docs: DataFrame, column: str) -> DataFrame:
    """doc_id and, as ``column``, all proposed spans of the whole text."""

    def make(batches):
        for batch in batches:
            spans = pa.array([found(t.as_py()) for t in batch.column("text")], pa.list_(SPAN))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), spans], ["doc_id", column])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(make, f"doc_id long, {column} {SPAN_DDL}")


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chance of each vote pattern to be personal data, and the labelers' reliabilities.

    votes: patterns by labelers; counts: how often each pattern occurs. Labelers are taken as
    independent given the truth. Reliability [labeler, truth, vote + 1] is the chance of a vote.
    """
    seen = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)  # pattern, labeler, vote
    start = np.array([[RIGHT, 1.0, WRONG], [WRONG, 1.0, RIGHT]])
    chance = 1 / (1 + np.exp(-votes.sum(axis=1)))
    for _ in range(ROUNDS):
        weight = np.stack((1 - chance, chance)) * counts
        reliability = np.einsum("tp,plv->ltv", weight, seen) + start
        reliability /= reliability.sum(axis=2, keepdims=True)
        share = (weight.sum(axis=1) + 1) / (counts.sum() + 2)
        like = np.log(share) + np.einsum("plv,ltv->pt", seen, np.log(reliability))
        chance = 1 / (1 + np.exp(np.clip(like[:, 0] - like[:, 1], -700, 700)))
    return chance, reliability


def logistic(bits: np.ndarray, chance: np.ndarray, counts: np.ndarray, decay: float = 1.0) -> np.ndarray:
    """Weights (the constant last) that give the chances from feature bits, by Newton's method."""
    x = np.hstack([features(bits), np.ones((len(bits), 1))])
    w = np.zeros(FEATURES + 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (counts * (p - chance)) + decay * w
        bend = (x * (counts * p * (1 - p))[:, None]).T @ x + decay * np.eye(FEATURES + 1)
        w -= np.linalg.solve(bend, slope)
    return w


def features(bits: np.ndarray) -> np.ndarray:
    return (bits[:, None] >> np.arange(FEATURES) & 1).astype(float)


def fit(proposed: DataFrame, column: str) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Chance of personal data for each (kind, feature bits), and the reliabilities by kind.

    Counts are over all spans of all documents. What comes to the driver is bounded: at most
    3 to the ``LABELERS`` patterns and 2 to the ``FEATURES`` bit sets of each kind.
    """
    spark = proposed.sparkSession
    spans = proposed.select(F.explode(column).alias("s")).select("s.kind", "s.votes", "s.bits")
    patterns = spans.groupBy("kind", "votes").count().collect()
    rows, reliabilities = [], {}
    for kind, name in enumerate(KINDS):
        own = sorted((r["votes"], r["count"]) for r in patterns if r["kind"] == kind)
        codes, counts = np.array([v for v, _ in own], int), np.array([n for _, n in own], float)
        chance, reliabilities[name] = expectation_maximisation(codes[:, None] // 3 ** np.arange(LABELERS) % 3 - 1, counts)
        rows += [(kind, int(v), float(p)) for v, p in zip(codes, chance)]
    known = spark.createDataFrame(rows, "kind int, votes int, chance double")
    learnt = spans.join(F.broadcast(known), ["kind", "votes"]).groupBy("kind", "bits").agg(F.avg("chance").alias("chance"), F.count("*").alias("n")).collect()
    table = np.zeros((len(KINDS), 2**FEATURES))
    every = np.arange(2**FEATURES)
    for kind in range(len(KINDS)):
        own = sorted((r["bits"], r["chance"], r["n"]) for r in learnt if r["kind"] == kind)
        if own:
            w = logistic(np.array([b for b, _, _ in own]), np.array([p for _, p, _ in own]), np.array([n for _, _, n in own], float))
            table[kind] = 1 / (1 + np.exp(-np.clip(features(every) @ w[:-1] + w[-1], -30, 30)))
    return table, reliabilities


RESULT_DDL = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def joined(spans) -> str:
    """Spans as kind:start:end, by kind as listed, then start."""
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def personal_data(docs: DataFrame) -> DataFrame:
    """Personal data of every whole text.

    docs: doc_id, text and any other columns. Returns a row per row of docs: doc_id; n_email,
    n_ip, n_card, n_phone: base spans of each kind; base_sha256: of the base spans; spans: base
    spans and those that the classifier adds, which touch no base span; n_added. A span that
    fails a check (Luhn, 255, number of digits) is never added. Null and empty texts have no
    spans. A repeated row and a null doc_id get their rows. An empty table gives no rows.
    """
    proposed = stored(propose(docs, "found"), "proposed")
    table, _ = fit(proposed, "found")
    accepted = table >= ACCEPTED

    def make(batches):
        for batch in batches:
            rows = []
            for spans in batch.column("found").to_pylist():
                base = [(s["kind"], s["start"], s["end"]) for s in spans if s["base"]]
                own, ends = [], {}
                for s in sorted((s for s in spans if not s["base"] and s["valid"] and accepted[s["kind"], s["bits"]]), key=lambda s: (s["kind"], s["start"])):
                    if s["start"] >= ends.get(s["kind"], 0):
                        own.append((s["kind"], s["start"], s["end"]))
                        ends[s["kind"]] = s["end"]
                n = [sum(k == kind for k, _, _ in base) for kind in range(len(KINDS))]
                rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + own), len(own)))
            columns = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            names = [c.split()[0] for c in RESULT_DDL.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds))], names)

    return proposed.mapInArrow(make, RESULT_DDL)
