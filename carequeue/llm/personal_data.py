"""Personal data in whole texts: fixed patterns, and a semi-Markov model that adds spans.

The base finds four kinds by pattern and check: email, ip, card, phone. Its spans stay as
they are. A semi-Markov conditional random field then looks at islands of text that hold
digits or an address sign and adds what the patterns miss: phone numbers in national
form, written-out addresses ("name at host dot org"), card numbers in other groupings.
Each candidate segment is scored as a whole (digits, checks, separators, the word before
it, what it touches), segments have at most ``MAX_TOKENS`` tokens, and dynamic programming
chooses boundaries and kinds jointly.

The weights are fitted on a bounded sample of documents (``SAMPLE`` ids, smallest hashes
first): spans of the base are the labels, half of them rewritten into the forms that the
base misses, and everything else in the sample shows what is not personal data.

Defined cases: null and empty texts have no spans; repeated rows give repeated results; a
sample without any span fits a model that adds nothing. Offsets are code points.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carequeue.llm.batches import map_rows

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 2000
MAX_TOKENS = 24
MIN_MARGIN = 2.0
EPOCHS = 6

Span = tuple[int, int]
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_NUMBERS = re.compile(r"[0-9][0-9.]*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def find_emails(text: str) -> list[Span]:
    """From each address sign: the run of local characters before it and a host after."""
    found, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            found.append((start, host.end()))
            done = host.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))
    return found


def find_ips(text: str) -> list[Span]:
    """Four groups of digits joined by single dots, in each run of digits and dots."""
    found = []
    for run in _NUMBERS.finditer(text):
        if run[0].count(".") < 3:
            continue
        groups, at = [], run.start()
        for g in run[0].split("."):
            groups.append((at, g))
            at += len(g) + 1
        i = 0
        while i + 3 < len(groups):
            four = groups[i : i + 4]
            if not all(g for _, g in four):
                i += 1
                continue
            if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or 0) <= 255 for _, g in four):
                found.append((four[0][0], four[3][0] + len(four[3][1])))
            i += 4
    return found


def find_cards(text: str) -> list[Span]:
    found = []
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(m.span())
    return found


def find_phones(text: str) -> list[Span]:
    if "+" not in text:
        return []
    return [
        m.span() for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.findall(m[0])) <= 15
    ]


def base_spans(text: str) -> dict[str, list[Span]]:
    digits = _DIGITS.search(text) is not None
    return {
        "email": find_emails(text),
        "ip": find_ips(text) if digits else [],
        "card": find_cards(text) if digits else [],
        "phone": find_phones(text) if digits else [],
    }


# the model ---------------------------------------------------------------------------
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]")
_TRIGGER = re.compile(r"@|[0-9][0-9().\x20-]*+")
_WRITTEN = re.compile(r"[\[(<{]at[\])>}]|\bat\b(?=\s\S{1,60}\sdot\s)")
_SIGNS = {"@", "at"}
MIN_DIGITS = 7
_CUES = {
    "tel": "phone", "phone": "phone", "call": "phone", "mobile": "phone", "fax": "phone",
    "mail": "email", "email": "email", "contact": "email",
    "card": "card", "visa": "card", "ip": "ip", "host": "ip", "address": "ip",
}


def islands(text: str) -> list[Span]:
    """Stretches around signs and digits, with some text on both sides, merged.

    Only those with a sign or ``MIN_DIGITS`` digits, without which there is no candidate.
    """
    marks = [(m.start(), m.end()) for m in _TRIGGER.finditer(text)]
    if "dot" in text or "at" in text and re.search(r"[\[(<{]at[\])>}]", text):
        marks = sorted([*marks, *(m.span() for m in _WRITTEN.finditer(text))])
    found: list[list[int]] = []
    for begin, end in marks:
        a, b = max(0, begin - 50), min(len(text), end + 60)
        if found and a <= found[-1][1]:
            found[-1][1] = b
        else:
            found.append([a, b])
    return [
        (a, b)
        for a, b in found
        if len(_DIGITS.findall(text, a, b)) >= MIN_DIGITS
        or "@" in text[a:b]
        or _WRITTEN.search(text, a, b)
    ]


def tokens_of(text: str, span: Span) -> list[Span]:
    return [m.span() for m in _TOKEN.finditer(text, *span)]


def segment_features(text: str, begin: int, end: int) -> dict[str, list[str]]:
    """Features of a whole candidate segment for each kind that it could be.

    Kinds whose necessary marks a segment lacks are not candidates at all.
    """
    s = text[begin:end]
    digits = _DIGITS.findall(s)
    n = len(digits)
    low = s.lower()
    before = re.findall(r"[a-z]+", text[max(0, begin - 24) : begin].lower())[-1:]
    left, right = text[begin - 1 : begin], text[end : end + 1]
    glued = bool(left) and (left.isalnum() or left in "._%+-@(") or right.isalnum()
    letters = bool(re.search(r"[A-Za-z]", s))
    common = [f"glued={glued}", *(f"cue={_CUES[w]}" for w in before if w in _CUES)]
    made: dict[str, list[str]] = {}
    words = re.findall(r"[a-z0-9]+|@", low)
    if ("@" in words or "at" in words) and "\n" not in s:
        sign = [w for w in words if w in ("@", "at")]
        dots = low.count(".") + words.count("dot")
        shape = re.fullmatch(
            r"[a-z0-9._%+-]+\s?[\[({<]?\s?(?:@|at)\s?[\])}>]?\s?[a-z0-9-]+"
            r"(?:\s?[\[({<]?\s?(?:\.|dot)\s?[\])}>]?\s?[a-z0-9-]+)+",
            low,
        )
        made["email"] = [
            f"signs={min(len(sign), 2)}", f"dots={min(dots, 3)}", f"shape={bool(shape)}",
            f"bracket={bool(re.search('[(<{[]', s))}", f"written={'@' not in s}",
            f"digits={min(n, 4)}", f"dotted={'dot' in words}",
        ]
    if not letters and n:
        groups = re.findall(r"[0-9]+", s)
        seps = "".join(sorted(set(re.sub(r"[0-9]", "", s))))
        shapes = "-".join(str(len(g)) for g in groups[:6])
        if 7 <= n <= 15 and "\n" not in s:
            made["phone"] = [
                f"plus={s.startswith('+')}", f"n={n}", f"groups={min(len(groups), 6)}",
                f"seps={seps}", f"shape={shapes}", f"paren={'(' in s and ')' in s}",
            ]
        if 15 <= n <= 19:
            made["card"] = [
                f"n={n}", f"luhn={luhn(''.join(digits))}", f"seps={seps}",
                f"even={len({len(g) for g in groups}) == 1}", f"groups={min(len(groups), 6)}",
            ]
        if len(groups) == 4 and 4 <= n <= 12 and seps in (".", " ."):
            inside = all(int(g) <= 255 for g in groups)
            made["ip"] = [f"octets={inside}", f"seps={seps}", f"chars={len(seps)}"]
    return {k: [f"{k}:{f}" for f in ["bias", *common, *fs]] for k, fs in made.items()}


def candidates(text: str, tokens: list[Span]) -> list[tuple[int, int, str, list[str]]]:
    """Segments (first token, token after the last, kind, features) that could be spans.

    A segment with letters needs a sign; one without needs digits, 19 at most. Segments
    that can be neither are left out before their features are made.
    """
    words = [text[a:b] for a, b in tokens]
    found = []
    for i, first in enumerate(words):
        if not (first.isalnum() or first in "+("):
            continue
        letters, signs, digits = False, 0, 0
        for j in range(i, min(len(tokens), i + MAX_TOKENS)):
            word = words[j]
            signs += word.lower() in _SIGNS
            letters = letters or word.isalpha()
            digits += len(word) if word.isdigit() else 0
            end = tokens[j][1]
            if end - tokens[i][0] > 100 or signs > 1 or (not letters and digits > 19):
                break
            if not word.isalnum() or not (signs or not letters and digits >= 4):
                continue
            for kind, features in segment_features(text, tokens[i][0], end).items():
                found.append((i, j + 1, kind, features))
    return found


class SemiMarkov:
    """Weights of segment features; text outside the segments scores 0 a token."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def score(self, features: Iterable[str]) -> float:
        return sum(self.weights.get(f, 0.0) for f in features)

    def best(self, n: int, segments) -> list[tuple[int, int, str]]:
        """The segmentation of n tokens with the highest score."""
        ending: dict[int, list] = {}
        for i, j, kind, features in segments:
            value = self.score(features) - MIN_MARGIN
            if value > 0:
                ending.setdefault(j, []).append((i, kind, value))
        top: list[float] = [0.0]
        back: list = [None]
        for j in range(1, n + 1):
            value, how = top[j - 1], None
            for i, kind, s in ending.get(j, ()):
                if top[i] + s > value:
                    value, how = top[i] + s, (i, kind)
            top.append(value)
            back.append(how)
        found, j = [], n
        while j:
            if back[j] is None:
                j -= 1
            else:
                i, kind = back[j]
                found.append((i, j, kind))
                j = i
        return found[::-1]

    def marginals(self, n: int, segments) -> list[float]:
        """The probability of each segment under the model: forward and backward sums."""
        scores = [self.score(f) for *_, f in segments]
        ending: dict[int, list[int]] = {}
        starting: dict[int, list[int]] = {}
        for k, (i, j, _, _) in enumerate(segments):
            ending.setdefault(j, []).append(k)
            starting.setdefault(i, []).append(k)
        ahead = [0.0] * (n + 1)
        for j in range(1, n + 1):
            ahead[j] = _log_sum(
                [ahead[j - 1], *(ahead[segments[k][0]] + scores[k] for k in ending.get(j, ()))]
            )
        behind = [0.0] * (n + 1)
        for i in range(n - 1, -1, -1):
            behind[i] = _log_sum(
                [behind[i + 1], *(behind[segments[k][1]] + scores[k] for k in starting.get(i, ()))]
            )
        return [
            math.exp(min(0.0, ahead[i] + scores[k] + behind[j] - ahead[n]))
            for k, (i, j, _, _) in enumerate(segments)
        ]


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def rewritten(kind: str, span: str, rng: random.Random) -> str:
    """A span in a form that the base does not find."""
    if kind == "email":
        local, host = span.split("@", 1)
        at = rng.choice([" [at] ", " (at) ", " at ", "(at)", " @ "])
        dot = " dot " if at == " at " else rng.choice([" [dot] ", " dot ", "."])
        return local + at + host.replace(".", dot)
    digits = "".join(_DIGITS.findall(span))
    if kind == "phone":
        last = digits[-10:]
        if len(last) < 10:
            return digits
        a, b, c = last[:3], last[3:6], last[6:]
        return rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}"])
    if kind == "card" and len(digits) == 16:
        return ".".join(digits[i : i + 4] for i in range(0, 16, 4))
    return span


def training_islands(texts: list[str], rng: random.Random) -> list[tuple[str, dict]]:
    """(text, {span: kind}) of each island, as found and rewritten."""
    made = []
    for text in texts:
        spans = sorted((a, b, k) for k, found in base_spans(text).items() for a, b in found)
        spans = [s for i, s in enumerate(spans) if i == 0 or s[0] >= spans[i - 1][1]]
        for a, b in islands(text):
            inside = [s for s in spans if a <= s[0] and s[1] <= b]
            for rewrite in (False, True) if inside else (False,):
                part, gold, done = "", {}, a
                for begin, end, kind in inside:
                    part += text[done:begin]
                    form = text[begin:end]
                    form = rewritten(kind, form, rng) if rewrite else form
                    gold[(len(part), len(part) + len(form))] = kind
                    part += form
                    done = end
                made.append((part + text[done:b], gold))
    return made


def fit(texts: list[str], seed: int = 7, most: int = 600) -> SemiMarkov:
    """Maximum conditional likelihood by stochastic gradient, at most ``most`` islands."""
    rng = random.Random(seed)
    made = training_islands(sorted(texts), rng)
    rng.shuffle(made)
    labelled = [x for x in made if x[1]][: most // 2]
    plain = [x for x in made if not x[1]][: most - len(labelled)]
    examples = []
    for text, gold in labelled + plain:
        tokens = tokens_of(text, (0, len(text)))
        segments = candidates(text, tokens)
        truth = [
            float(gold.get((tokens[i][0], tokens[j - 1][1])) == kind) for i, j, kind, _ in segments
        ]
        if segments:
            examples.append((len(tokens), segments, truth))
    weights: dict[str, float] = {}
    model = SemiMarkov(weights)
    for _, segments, _ in examples:
        for _, _, kind, _ in segments:
            weights.setdefault(f"{kind}:bias", -4.0)
    for epoch in range(EPOCHS):
        rng.shuffle(examples)
        rate = 0.5 / (1 + epoch)
        for n, segments, truth in examples:
            for (_, _, _, features), p, y in zip(segments, model.marginals(n, segments), truth):
                if abs(y - p) > 1e-3:
                    for f in features:
                        weights[f] = weights.get(f, 0.0) + rate * (y - p)
    return model


def added_spans(text: str, base: dict[str, list[Span]], model: SemiMarkov) -> list[tuple]:
    """(kind, begin, end) that the model finds and that touch no span of the base."""
    taken = [s for found in base.values() for s in found]
    whole, added = text, []
    for a, b in taken:  # what the base has found is not looked at again
        text = text[:a] + " " * (b - a) + text[b:]
    for island in islands(text):
        tokens = tokens_of(text, island)
        for i, j, kind in model.best(len(tokens), candidates(text, tokens)):
            begin, end = tokens[i][0], tokens[j - 1][1]
            if whole[begin:end] == text[begin:end]:
                added.append((kind, begin, end))
    return added


def all_spans(text: str, model: SemiMarkov) -> tuple[list[tuple], list[tuple]]:
    """Spans (kind, begin, end) of the base, and all, each by kind and then begin."""
    base = base_spans(text)
    first = [(k, a, b) for k in KINDS for a, b in base[k]]
    # the model can only add where there is a digit or a sign
    more = added_spans(text, base, model) if model.weights else []
    everything = sorted([*first, *more], key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return first, everything


def fit_on(docs: DataFrame, sample: int = SAMPLE) -> SemiMarkov:
    """Fit on the texts of the ``sample`` ids with the smallest hashes.

    At most ``sample`` texts are fetched, and of them only the islands.
    """
    chosen = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen.distinct()), "doc_id")

    def make():
        def work(rows):
            return [([t[a:b] for a, b in islands(t)],) for t in rows]

        return work

    found = map_rows(texts, make, "parts array<string>").where(F.size("parts") > 0)
    bounded = found.select(F.explode("parts").alias("part")).distinct()
    bounded = bounded.orderBy(F.xxhash64("part"), "part").limit(4 * sample)
    return fit([r.part for r in bounded.collect()])


def _joined(spans: list[tuple]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame, model: SemiMarkov | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of each document."""
    model = model or fit_on(docs)

    def make():
        def work(texts):
            rows = []
            for text in texts:
                base, every = all_spans(text, model)
                kinds = [s[0] for s in base]
                digest = hashlib.sha256(_joined(base).encode()).hexdigest()
                rows.append((*(kinds.count(k) for k in KINDS), digest, _joined(every)))
            return rows

        return work

    return map_rows(
        docs.select("doc_id", "text"),
        make,
        "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string",
    )


def redact(text: str, spans: list[tuple]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans
    become one, named after the first."""
    out, done = [], 0
    for kind, begin, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if begin >= done:
            out += [text[done:begin], f"<{kind.upper()}>"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def redacted_documents(docs: DataFrame, model: SemiMarkov | None = None) -> DataFrame:
    """The documents with personal data replaced in their texts; null texts stay null.

    Texts without a span are returned as they are; all columns are kept, in their order.
    A text goes to a worker once, beside the other columns of its row.
    """
    model = model or fit_on(docs)

    def make():
        def work(texts):
            return [(redact(t, all_spans(t, model)[1]),) for t in texts]

        return work

    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    kept = docs.select(others.alias("_row"), F.isnotnull("text").alias("_present"), "text")
    made = map_rows(kept, make, "_redacted string")
    text = F.when(F.col("_present"), F.col("_redacted"))
    return made.select(
        *[text.alias(c) if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns]
    )
