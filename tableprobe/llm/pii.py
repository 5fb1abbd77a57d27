"""Personal data in texts, by weak supervision: labelers vote, expectation-maximisation weighs them, and a span classifier decides.

*Base.* Four kinds have a fixed form and check: e-mail addresses, IPv4 addresses, card numbers and phone numbers. Those spans are always kept.

*Candidates.* Looser forms give further spans: addresses written around (`name (at) host dot org`), quads written `1[.]2[.]3[.]4`, numbers with
other separators, numbers that touch one another, so that the fixed form takes them for one that fails its check, national phone numbers. Numbers
of a card have to pass their check digit here too.

*Votes.* Every candidate, base spans included, is voted for (1), against (-1) or not at all (0) by labelers of three sorts: regular
expressions (the fixed form; the usual shape), gazetteers (top-level domains and mail hosts, issuer prefixes, calling codes, reserved networks) and context
(words just before; what the span touches; base spans nearby). Spark counts the vote patterns of each kind over all documents; there are 729 at most. On these counts
expectation-maximisation estimates the share of true candidates and each labeler's reliability, starting from the belief that votes
are more often right than wrong, which also tells the two classes apart.

*Classifier.* A logistic regression on hashed features of the span and its surroundings, without the votes, is trained on the estimated
probabilities of a sample: at most `SAMPLE` candidates of each kind, those with the smallest hashes. It then scores all candidates of all documents; those
at `threshold` or more that meet no base span are added; of those that overlap one another the longest, and of equals the likeliest.

Positions are code points, ends exclusive. Texts are read once, whole, in linear time, and not shuffled: what is written and read again are the few
numbers of each candidate. Defined cases: null and empty texts have no spans. Repeated rows are found alike. An
empty table gives no rows; without candidates nothing is added. All columns but the text are kept in the struct `row`, so their names can't clash.
Bytes that are no UTF-8 count as U+FFFD.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tableprobe.llm.common import prepare, saved

KINDS = ("email", "ip", "card", "phone")
#: Candidates of each kind that the classifier is trained on, at most.
SAMPLE = 5000
FEATURES = 1 << 14
LABELERS = ("form", "shape", "gazetteer", "words", "touching", "nearby")
#: Code points before a span that are its context.
CONTEXT = 48

# Gazetteers and context words.
_DOMAINS = frozenset(
    "com org net edu gov mil int info biz name io dev app ai co me tv eu uk de fr es it nl be ch at pl se no dk fi pt ie cz gr ru ua tr il in cn jp kr "
    "au nz ca us mx br ar cl za eg ng ke example test".split()
)
_MAIL_HOSTS = ("mail", "gmail", "outlook", "hotmail", "yahoo", "icloud", "proton", "gmx", "aol", "web")
_CALLING_CODES = frozenset(
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 "
    "218 220 234 254 351 352 353 354 358 359 370 371 372 380 385 386 420 421 852 886 961 962 963 964 965 966 971 972 973 974".split()
)
_ISSUERS = re.compile("4|5[1-5]|2[2-7]|3[47]|3[068]|35|6011|64|65|62|50|5[6-8]|6[37]")
_FOR = {
    "email": "mail email contact write reach address correo courriel kontakt".split(),
    "ip": "ip host server address client addr proxy network dns gateway".split(),
    "card": "card visa mastercard amex credit debit payment carte karte tarjeta".split(),
    "phone": "phone tel telephone call fax mobile cell contact whatsapp sms telefon telefono".split(),
}
_AGAINST = "token key hash secret version release isbn issn doi section order invoice build commit checksum sha md5 uuid".split()

_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_QUAD = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

_AROUND = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]| at |@) ?[A-Za-z0-9-]{1,63}+"
    r"(?:(?: ?(?:\(dot\)|\[dot\]| dot ) ?|\.)[A-Za-z0-9-]{1,63}+){1,8}",
    re.I,
)
_AROUND_QUAD = re.compile(r"(?<![0-9])[0-9]{1,3}+(?:\[\.\]|\(\.\))[0-9]{1,3}+(?:(?:\[\.\]|\(\.\)|\.)[0-9]{1,3}+){2}(?![0-9])")
_LOOSE_CHAIN = re.compile("[0-9]++(?:[ . –-][0-9]++)*+")
_LOOSE_PHONES = (
    re.compile(r"(?<![0-9])(?:\+|00)[1-9][0-9]{0,2}+[ .-]?\([0-9]{1,4}\)[ .-]?[0-9]{2,4}(?:[ .-][0-9]{2,4}){0,2}(?!\.?[0-9])"),
    re.compile(r"(?<![0-9])(?:\+|00)[1-9][0-9]{0,2}+(?:[ .-][0-9]{2,4}){2,4}(?!\.?[0-9])"),
    re.compile(r"(?<![0-9+])(?<!\+[0-9][ .-])(?<!\+[0-9]{2}[ .-])(?<!\+[0-9]{3}[ .-])\([0-9]{2,5}\)[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}(?!\.?[0-9])"),
    re.compile(r"(?<![0-9])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?!\.?[0-9])"),
)
_USUAL = {
    "email": re.compile(r"[A-Za-z0-9]+(?:[._%+-][A-Za-z0-9]+)*@[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*(?:\.[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*)*\.[A-Za-z]{2,10}"),
    "ip": re.compile(r"(?:0|[1-9][0-9]*)(?:\.(?:0|[1-9][0-9]*)){3}"),
    "card": re.compile(r"[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5}"),
    "phone": re.compile(r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{2,5}\)[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}"),
}


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the others."""
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(2 * int(d) - 9 * (d > "4") for d in even)) % 10 == 0


def _quad(text: str, separator: str = ".") -> bool:
    parts = [p.lstrip("0") for p in text.split(separator)]
    return len(parts) == 4 and all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def _card(text: str) -> bool:
    digits = _digits(text)
    return 13 <= len(digits) <= 19 and luhn(digits)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the fixed forms that pass their checks, by kind and start."""
    found = []
    at, end = text.find("@"), 0
    while at >= 0:
        # an address has one @; its name is the run before, back to the address before
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            end = host.end()
            found.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    if _DIGIT.search(text):
        found += [("ip", *m.span()) for m in _QUAD.finditer(text) if _quad(m.group())]
        found += [("card", *m.span()) for m in _CHAIN.finditer(text) if 14 <= m.end() - m.start() + 1 and _card(m.group())]
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return found


def loose_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the looser forms."""
    found = []
    low = text.lower() if "@" in text or "(" in text or "[" in text or " at " in text else ""
    if "(at)" in low or "[at]" in low or "(dot)" in low or "[dot]" in low or (" at " in low and " dot " in low) or "@ " in low or " @" in low:
        # "look at host.org" is no address
        found += [("email", *m.span()) for m in _AROUND.finditer(text) if " at " not in m.group().lower() or "dot" in m.group().lower()]
    if not _DIGIT.search(text):
        return found
    if "." in text:
        found += [("ip", *m.span()) for m in _AROUND_QUAD.finditer(text) if _quad(re.sub(r"[\[\]()]", "", m.group()))]
    for chain in _LOOSE_CHAIN.finditer(text):
        if chain.end() - chain.start() < 13:
            continue
        groups = [(m.start() + chain.start(), m.end() + chain.start()) for m in re.finditer("[0-9]+", chain.group())]
        for k, (start, _) in enumerate(groups):
            # whole groups that make a number as it is usually written
            for more, sizes in ((1, None), (4, (4, 4, 4, 4)), (3, (4, 6, 5)), (5, (4, 4, 4, 4, 3))):
                run = groups[k : k + more]
                lengths = tuple(e - s for s, e in run)
                if len(run) == more and (lengths == sizes if sizes else 13 <= lengths[0] <= 19) and _card(text[start : run[-1][1]]):
                    found.append(("card", start, run[-1][1]))
    for form in _LOOSE_PHONES:
        found += [("phone", *m.span()) for m in form.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return found


def _votes(kind: str, span: str, base: bool, before: str, after: str, near: bool) -> list[int]:
    """One vote per labeler."""
    digits = _digits(span)
    words = re.findall("[a-z]+", before.lower())[-4:]
    if kind == "email":
        host = re.split("[@ \\])]", span)[-1].lower().split(".")
        gazetteer = 1 if host[-1] in _DOMAINS or any(h.startswith(_MAIL_HOSTS) for h in host[:-1]) else -1
    elif kind == "ip":
        first = int(re.match("0*([0-9]{0,3})", span).group(1) or 0)
        gazetteer = 1 if first in (10, 100, 172, 192) else -1 if first == 0 or 240 <= first else 0
    elif kind == "card":
        gazetteer = 1 if _ISSUERS.match(digits) else -1
    else:
        code = digits.lstrip("0") if span.startswith("00") else digits
        gazetteer = 0 if span[0] not in "+0" else 1 if any(code[:n] in _CALLING_CODES for n in (1, 2, 3)) else -1
    said = 1 if any(w in _FOR[kind] for w in words) else -1 if any(w in _AGAINST for w in words) else 0
    last, following = before[-1:], after[:1]
    free = not (last.isalnum() or following.isalnum() or last in ("=", '"', "'", "#", "/", "_") and last or following in ("_", "=") and following)
    return [1 if base else 0, 1 if _USUAL[kind].fullmatch(span) else -1, gazetteer, said, 1 if free else -1, 1 if near else 0]


def _shape(text: str) -> str:
    """Letters as a, digits as 9, runs cut to three."""
    return re.sub(r"(a|9)\1{3,}", r"\1\1\1", re.sub("[0-9]", "9", re.sub("[A-Za-z]", "a", text[:80])))


def _features(kind: str, span: str, before: str, after: str) -> list[int]:
    """Hashed features of a span and its surroundings."""
    words = before.lower().split()[-2:]
    digits = _digits(span)
    named = [
        "bias",
        f"shape {_shape(span)}",
        f"digits {min(len(digits), 24)}",
        f"first {digits[:2]}",
        f"last {_shape(before[-2:])}",
        f"next {_shape(after[:2])}",
        f"tail {_shape(span.rsplit('.', 1)[-1])}",
        f"marks {''.join(sorted(set(re.sub('[A-Za-z0-9]', '', span))))}",
        f"word {words[-1] if words else ''}",
        f"words {' '.join(words)}",
        f"after {' '.join(after.lower().split()[:1])}",
    ]
    return [zlib.crc32(f"{kind} {name}".encode()) % FEATURES for name in named]


def candidates(text: str) -> tuple[list[tuple[str, int, int]], list[tuple]]:
    """The base spans of a text, and its candidates as (kind, start, end, base, votes, features)."""
    base = base_spans(text)
    fixed = set(base)
    spans = sorted(fixed.union(loose_spans(text)), key=lambda s: (s[1], s[2], s[0]))
    starts = sorted(s for _, s, _ in base)
    out = []
    for kind, start, end in spans:
        before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
        at = bisect_left(starts, start - 200)
        around = [s for s in starts[at : at + 3] if s <= end + 200 and not start <= s < end]
        votes = _votes(kind, text[start:end], (kind, start, end) in fixed, before, after, bool(around))
        pattern = 0
        for vote in votes:
            pattern = 3 * pattern + vote + 1
        out.append((KINDS.index(kind), start, end, (kind, start, end) in fixed, pattern, _features(kind, text[start:end], before, after)))
    return base, out


# over a table -----------------------------------------------------------------------------

_SPAN = "struct<kind: int, start: int, end: int>"
_CANDIDATE = "struct<kind: int, start: int, end: int, base: boolean, votes: int, features: array<int>>"
_SPAN_ARROW = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
_CANDIDATE_ARROW = pa.struct([*_SPAN_ARROW, ("base", pa.bool_()), ("votes", pa.int32()), ("features", pa.list_(pa.int32()))])


def _lists(kind: pa.StructType, rows: list[list[tuple]]) -> pa.Array:
    """A list of structs per row."""
    flat = [item for row in rows for item in row]
    columns = list(zip(*flat)) or [()] * len(kind)
    values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], fields=list(kind))
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, rows))], pa.int32()), values)


def _seen(texts: pa.Array) -> pa.Array:
    found = [candidates((t or b"").decode("utf-8", "replace")) for t in texts.cast(pa.binary()).to_pylist()]
    base = _lists(_SPAN_ARROW, [[(KINDS.index(kind), start, end) for kind, start, end in spans] for spans, _ in found])
    return pa.StructArray.from_arrays([base, _lists(_CANDIDATE_ARROW, [c for _, c in found])], names=["base", "candidates"])


def reliabilities(patterns: dict[int, int], steps: int = 200) -> tuple[float, np.ndarray, dict[int, float]]:
    """The share of true candidates, P(vote | false or true) per labeler, and per vote pattern the probability that it is true."""
    number = len(LABELERS)
    keys = np.array(sorted(patterns), np.int64)
    counts = np.array([patterns[k] for k in keys], float)
    votes = np.stack([keys // 3 ** (number - 1 - k) % 3 for k in range(number)], axis=1) if len(keys) else np.zeros((0, number), np.int64)
    # the belief that votes are rather right, worth this many candidates
    belief = np.array([[4.0, 3.0, 2.0], [2.0, 3.0, 4.0]])
    share, table = 0.5, np.tile(belief[:, None, :] / 9, (1, number, 1))

    def likely():
        logs = np.log(table)[:, np.arange(number), votes].sum(2) + np.log([[1 - share], [share]])
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))

    for _ in range(steps):
        true = likely() * counts
        mass = np.stack([counts - true, true])
        new = np.tile(belief[:, None, :], (1, number, 1))
        for v in range(3):
            new[:, :, v] += mass @ (votes == v)
        new /= new.sum(2, keepdims=True)
        moved = np.abs(new - table).max()
        table, share = new, (true.sum() + 1) / (counts.sum() + 2)
        if moved < 1e-9:
            break
    return share, table, dict(zip(keys.tolist(), likely().tolist()))


def train_spans(features: np.ndarray, truth: np.ndarray, steps: int = 300, rate: float = 0.1, decay: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression on rows of feature numbers and probabilities, by Adam on all rows."""
    weights, mean, square = np.zeros(FEATURES), np.zeros(FEATURES), np.zeros(FEATURES)
    if not len(features):
        return weights
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(weights[features].sum(1), -40, 40)))
        slope = np.bincount(features.ravel(), np.repeat(p - truth, features.shape[1]), FEATURES) / len(features) + decay * weights
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        weights = weights - rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return weights


def choose(spans: list[dict], taken: list[dict], weights: np.ndarray, threshold: float) -> list[tuple]:
    """The candidates to add: (kind, start, end)."""
    busy = sorted((s["start"], s["end"]) for s in taken)
    scored = []
    for c in spans:
        p = 1 / (1 + np.exp(-np.clip(weights[c["features"]].sum(), -40, 40)))
        if p >= threshold and not c["base"]:
            scored.append((c["start"] - c["end"], -p, c["start"], c["kind"], c["end"]))
    out = []
    for _, _, start, kind, end in sorted(scored):
        at = bisect_left(busy, (end, 0))
        # spans that are taken don't meet one another but for base spans of several kinds
        if all(e <= start for _, e in busy[max(0, at - len(KINDS)) : at]):
            out.append((kind, start, end))
            busy.insert(at, (start, end))
    return out


def find_personal_data(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Every row without its text as the struct `row`, with `base` and `spans`, arrays of (kind, start, end) by kind and start; `kind` is a number in `KINDS`."""
    prepare(docs.sparkSession)
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != text]).alias("row")
    seen = F.arrow_udf(_seen, f"struct<base: array<{_SPAN}>, candidates: array<{_CANDIDATE}>>")(docs[f"`{text}`"]).alias("seen")
    found = saved(docs.select(row, seen), "pii-candidates").select("row", "seen.*")
    each = found.select(F.explode("candidates").alias("c")).select("c.*")
    patterns: dict[int, dict[int, int]] = {k: {} for k in range(len(KINDS))}
    # at most 729 patterns of each kind
    for r in each.groupBy("kind", "votes").count().collect():
        patterns[r.kind][r.votes] = r["count"]
    truth = {k: reliabilities(p)[2] for k, p in patterns.items()}
    features, labels = [], []
    for k in range(len(KINDS)):
        if patterns[k]:
            drawn = each.where(F.col("kind") == k).orderBy(F.xxhash64("features", "start", "votes"), "features").limit(SAMPLE)
            for r in drawn.select("votes", "features").collect():
                features.append(r.features)
                labels.append(truth[k][r.votes])
    weights = train_spans(np.array(features, np.int64), np.array(labels))

    def added(base: pa.Array, spans: pa.Array) -> pa.Array:
        rows = [choose(c, b, weights, threshold) if c else [] for b, c in zip(base.to_pylist(), spans.to_pylist())]
        return _lists(_SPAN_ARROW, rows)

    more = F.arrow_udf(added, f"array<{_SPAN}>")("base", "candidates")
    return found.select("row", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", more)).alias("spans"))


def span_text(spans: Column) -> Column:
    """`kind:start:end` of all spans, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def number_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
