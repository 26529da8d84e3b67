"""Token counts by merging pre-tokens, with counts of chunks composed in order.

Between pre-tokens the tokenizer is in one state, and a pre-token leads back to it, emitting
a number of tokens. Numbers are worked out by merging when a pre-token is first met and then
kept in a bounded table. Characters that the library's Unicode tables and Python's take in
unlike ways are found by trying each; a text with any of them is normalized by the library's
own normalizer and split by the letters and digits of its tables.

A long text is read in chunks that are counted independently. What a chunk does is a map
(head, count, tail): the open text before its first white space, which belongs to whatever
was open when the chunk began, the tokens between its first and last white space, and the
open text after that. These maps compose associatively, and a prefix scan over them gives
the tokens up to each chunk and so of the whole. White space ends every pre-token, is never
part of one, and never takes part in normalization across it, so the result equals counting
the text at once.

Special strings inside a text count as one token each, as the library does by default.
Defined cases: null and empty texts have 0 tokens; texts of any length are counted whole.
"""

from __future__ import annotations

import json
import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carequeue.llm.batches import map_rows
from carequeue.llm.bpe import NEVER, merge

LIMIT = 2048
CHUNK = 16_384
LETTERS_END = 0x40000  # planes from the fourth on have no letters or digits
KEPT_TRANSITIONS = 600_000
# The white space of the tokenizer's patterns.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"


@dataclass(frozen=True)
class ChunkMap:
    """What a chunk does to the transducer; ``closed`` if it has white space at all."""

    head: str
    count: int
    tail: str
    closed: bool


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


@dataclass(frozen=True)
class Letters:
    """Insides of character classes: the letters and the digits of the library's tables, and
    the characters that Python's tables take for something else."""

    letters: str
    digits: str
    unlike: str


@lru_cache(maxsize=2)
def letters_of(path: str) -> Letters:
    """Read off what the library does to every character, many of them at a time."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    found: dict[str, list[int]] = {"letters": [], "digits": [], "unlike": []}
    step = 1 << 10
    for first in range(0, LETTERS_END, step):
        points = [
            p for p in range(max(first, 0x80), first + step) if not 0xD800 <= p <= 0xDFFF
        ]
        points = [p for p in points if not _FIRST.match(chr(p))]
        # a letter joins the letters beside it, and two digits are two pieces
        for kind, form, width, wanted in (("letters", "a{0}a ", 4, 1), ("digits", "{0}{0} ", 3, 2)):
            line = "".join(form.format(chr(p)) for p in points)
            begins = [b for _, (b, _) in library.pre_tokenizer.pre_tokenize_str(line)]
            pieces = np.bincount(np.array(begins, np.int64) // width, minlength=len(points))
            own = [p for p, n in zip(points, pieces) if n == wanted]
            found[kind] += own
            ours = _LETTER if kind == "letters" else _DIGIT
            found["unlike"] += set(own) ^ {p for p in points if ours.match(chr(p))}
        # alone, and among marks that composition and reordering move
        for form in ("{0}", "a{0}\u0323\u0301b", "\u0391\u0345{0}\u0301"):
            texts = [form.format(chr(p)) for p in points]
            theirs = library.normalizer.normalize_str(" ".join(texts)).split(" ")
            if len(theirs) != len(texts):  # white space among them
                theirs = [library.normalizer.normalize_str(t) for t in texts]
            plain = [lowered(unicodedata.normalize("NFC", t)) for t in texts]
            found["unlike"] += [p for p, a, b in zip(points, theirs, plain) if a != b]
    return Letters(*(_ranges(sorted(set(v))) for v in found.values()))


_LETTER, _DIGIT = regex.compile(r"\p{L}"), regex.compile(r"\p{N}")


def lowered(text: str) -> str:
    """Lower case character by character: a sigma at a word's end is like any other."""
    if "Σ" in text:
        return "σ".join(p.lower() for p in text.split("Σ"))
    return text.lower()


def _ranges(points: list[int]) -> str:
    """Sorted code points as ranges of a character class."""
    found: list[list[int]] = []
    for p in points:
        if found and p == found[-1][1] + 1:
            found[-1][1] = p
        else:
            found.append([p, p])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in found)


class Transducer:
    def __init__(self, path: str, classes: Letters):
        from tokenizers import Tokenizer

        self.normalize = Tokenizer.from_file(path).normalizer.normalize_str
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = spec["normalizer"]["normalizers"]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if (
            model["type"] != "BPE"
            or [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"]
            or (split["type"], level["type"]) != ("Split", "ByteLevel")
            or any(t["normalized"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])
        ):
            raise ValueError(f"{path} is not a tokenizer this transducer is compiled from")
        self.ranks = {tuple(p): i for i, p in enumerate(model["merges"])}
        self.word_end = model["end_of_word_suffix"]
        pattern = split["pattern"]["Regex"]
        self.pre_token = regex.compile(pattern.replace(r"\s", WHITE))
        self.unlike = re.compile(f"[{classes.unlike}]") if classes.unlike else None
        self.library_pre_token = regex.compile(
            pattern.replace(r"\s", WHITE)
            .replace(r"[\p{L}]", f"[a-zA-Z{classes.letters}]")
            .replace(r"[\p{N}]", f"[0-9{classes.digits}]")
            .replace(r"\p{L}", f"a-zA-Z{classes.letters}")
            .replace(r"\p{N}", f"0-9{classes.digits}")
        )
        self.ascii_pre_token = re.compile(
            pattern.replace(r"\s", "\t\n\x0b\x0c\r ")
            .replace(r"[\p{L}]", "[a-z]").replace(r"[\p{N}]", "[0-9]")
            .replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9")
        )
        special = "|".join(re.escape(t["content"]) for t in spec["added_tokens"])
        self.special = re.compile(special) if special else None
        self.letters = byte_letters()
        self.transitions: dict[str, int] = {}

    def emitted(self, pre_token: str) -> int:
        """Tokens on the transition that a pre-token takes; compiled on first sight."""
        found = self.transitions.get(pre_token)
        if found is None:
            symbols = [self.letters[b] for b in pre_token.encode()]
            symbols[-1] += self.word_end
            ranks = self.ranks
            found = len(merge(symbols, lambda a, b, get=ranks.get: get((a, b), NEVER)))
            if len(self.transitions) >= KEPT_TRANSITIONS:
                self.transitions.clear()
            self.transitions[pre_token] = found
        return found

    def closed_count(self, text: str) -> int:
        """Tokens of a text that starts and ends between pre-tokens."""
        if text.isascii():
            words = self.ascii_pre_token.findall(text.lower())
        elif self.unlike and self.unlike.search(text):
            words = self.library_pre_token.findall(self.normalize(text))
        else:
            words = self.pre_token.findall(lowered(unicodedata.normalize("NFC", text)))
        get, emitted = self.transitions.get, self.emitted
        return sum([get(w) or emitted(w) for w in words])

    def chunk_map(self, text: str) -> ChunkMap:
        first, last = _FIRST.search(text), _LAST.search(text)
        if first is None:
            return ChunkMap(text, 0, "", False)
        inner = text[first.start() : last.end()]
        return ChunkMap(text[: first.start()], self.closed_count(inner), text[last.end() :], True)

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        if not a.closed and not b.closed:
            return ChunkMap(a.head + b.head, 0, "", False)
        if not a.closed:
            return ChunkMap(a.head + b.head, b.count, b.tail, True)
        if not b.closed:
            return ChunkMap(a.head, a.count, a.tail + b.head, True)
        count = a.count + self.closed_count(a.tail + b.head) + b.count
        return ChunkMap(a.head, count, b.tail, True)

    def total(self, m: ChunkMap) -> int:
        return self.closed_count(m.head) + m.count + self.closed_count(m.tail)

    def prefix_maps(self, text: str, chunk: int = CHUNK) -> list[ChunkMap]:
        """The maps of the text's first chunk, first two chunks and so on."""
        maps = [self.chunk_map(text[i : i + chunk]) for i in range(0, len(text), chunk)]
        return list(accumulate(maps, self.compose))

    def count(self, text: str, chunk: int = CHUNK) -> int:
        parts = self.special.split(text) if self.special else [text]
        found = len(parts) - 1
        for part in parts:
            if len(part) <= chunk:
                found += self.closed_count(part)
            else:
                found += self.total(self.prefix_maps(part, chunk)[-1])
        return found


_FIRST = re.compile(f"[{WHITE}]")
_LAST = re.compile(f"(?s)[{WHITE}](?=[^{WHITE}]*$)")


@lru_cache(maxsize=2)
def transducer_of(path: str, classes: Letters) -> Transducer:
    """Tasks of one worker share the transitions compiled so far."""
    return Transducer(path, classes)


def counted_documents(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each document."""

    classes = letters_of(path)

    def make():
        transducer = transducer_of(path, classes)
        return lambda texts: [(transducer.count(t),) for t in texts]

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    rows = docs.select("doc_id", size.alias("n_bytes"), "text")
    counted = map_rows(rows, make, "n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
