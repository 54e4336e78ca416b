"""Noise in text from scanned pages: furniture, broken words, misread characters, paragraphs."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ravelin.session import cut

TRIGRAMS = 1 << 16
WIDEST = 110
FINDING = "doc_id string, line_no int, kind string, repaired string"
#: Mean and deviation of the logarithm of a paragraph's characters where no text tells.
USUAL = (5.8, 0.8)
PARAGRAPH = "doc_id string, paragraph_no int, text string"

#: What is printed, and what scanners read for it.
CONFUSIONS = (
    ("o", "0"), ("o", "c"), ("c", "o"), ("e", "c"), ("c", "e"), ("l", "1"), ("l", "|"), ("l", "i"), ("i", "l"), ("i", "1"), ("i", "|"), ("t", "l"), ("l", "t"),
    ("s", "5"), ("b", "6"), ("g", "9"), ("b", "8"), ("z", "2"), ("q", "9"), ("t", "7"), ("a", "4"), ("e", "3"), ("h", "b"), ("b", "h"), ("n", "h"), ("h", "n"),
    ("m", "rn"), ("rn", "m"), ("nn", "rm"), ("d", "cl"), ("cl", "d"), ("u", "ii"), ("w", "vv"), ("u", "v"), ("v", "u"), ("n", "u"), ("u", "n"), ("n", "ri"), ("ni", "m"), ("m", "ni"),
    ("h", "li"), ("k", "lc"), ("f", "t"), ("t", "f"), ("fi", "ﬁ"), ("fl", "ﬂ"), ("ff", "ﬀ"), ("ffi", "ﬃ"), ("ffl", "ﬄ"), ("y", "v"), ("g", "q"), ("q", "g"), ("a", "o"), ("o", "a"), ("in", "m"), ("ll", "u"), ("li", "h"),
)
#: Characters that stand for digits in misread numbers.
DIGITS = str.maketrans("OoQDIl|iSsBZzgqb", "0000111155822996")
HYPHENS = "-­¬‐‑"
ENDS = ".!?:;,…。！？"
PAGE_NO = r"(?:[0-9][0-9OolI|S]{0,4}|[OolI|S]{1,2}[0-9]{1,3})"
NUMBER_LINE = re.compile(
    rf"^\W*(?:(?:page|p\.|pg\.|seite|chapter|chap\.)\s*)?{PAGE_NO}(?:\s*(?:/|of|von|sur|de)\s*{PAGE_NO})?\W*$|^\W*[ivxlc]{{1,7}}\W*$", re.I
)
NUMBER_TAIL = re.compile(r"\s{2,}(?:[-—–\[(]\s*)?(?:(?:page|p\.)\s*)?[0-9OolI|ivx]{1,6}(?:\s*(?:/|of)\s*[0-9OolI|]{1,5})?(?:\s*[-—–\])])?\s*$|\s{2,}Chapter \d+\s*$", re.I)
NUMERIC = re.compile(r"^[#§$€£]?[+-]?\d[\d.,:/%-]*$")
WORDS = re.compile(r"[^\W_]+(?:[-'’][^\W_]+)*")
INTO: dict[str, list[str]] = {}
for _right, _seen in CONFUSIONS:
    INTO.setdefault(_seen, []).append(_right)
#: The strokes of characters. Both sides of every confusion have the same ones, so a word has those of all that it may be read as.
STROKE_SETS = {"i": "ilftr1|7", "ii": "nuhbvy68ﬁﬂﬀ", "iii": "mﬃﬄ", "iiii": "w", "o": "ocea034", "oi": "d", "io": "k", "g": "gq9", "s": "s5", "z": "z2"}
STROKES = {ord(c): made for made, chars in STROKE_SETS.items() for c in chars}
#: Scanned texts that are read together with the part of the lexicon they need.
BLOCK = 128
#: Costs in bits: of a confusion, of dropping or adding a blank, of a word that nobody else writes beyond the rarest known one.
CONFUSED, BLANK, UNKNOWN = 5.0, 6.0, 14.0


def is_scan(text: Column) -> Column:
    """Whether a text came from pages: it has several lines and nine in ten are no wider than a page (a text that was not scanned has its paragraphs whole)."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return (F.size(lines) > 1) & (10 * F.size(F.filter(lines, lambda x: F.length(x) <= WIDEST)) >= 9 * F.size(lines)) & text.rlike(r"[^\n]{25,}\n+[^\n]")


def strokes(word: str) -> str:
    return word.translate(STROKES)


def strokes_of(c: Column) -> Column:
    """``strokes`` of a column."""
    c = F.translate(c, "".join(STROKE_SETS.values()), "".join(chars[0] * len(chars) for chars in STROKE_SETS.values()))
    for made, chars in STROKE_SETS.items():
        if len(made) > 1:
            c = F.replace(c, F.lit(chars[0]), F.lit(made))
    return c


class Excerpt:
    """The words of a lexicon that some texts ask for, each with its count, and the counts of letter trigrams.

    ``total`` is the number of words in all texts; the cost of a word is its code length in bits.
    """

    def __init__(self, counts: dict[str, int], trigrams: np.ndarray, total: int):
        self.counts, self.trigrams, self.alike = counts, np.log1p(trigrams), {}
        self.bits = float(np.log2(max(total, 2)))
        for word in counts:
            self.alike.setdefault(strokes(word), []).append(word)

    def level(self, word: str) -> float:
        """The binary logarithm of the count, plus 1; 0 for an unknown word."""
        n = self.counts.get(word, 0)
        return 1 + math.log2(n) if n else 0.0

    def near(self, word: str, most: int) -> Iterator[tuple[str, int]]:
        """Known words that ``word`` may stand for, with the number of confusions (1 to ``most``), the commonest first."""
        others = sorted(self.alike.get(strokes(word), ()), key=lambda w: (-self.counts[w], w))
        return ((other, cost) for other in others if (cost := confusions(word, other)) and cost <= most)

    def likeliest(self, choices: list[str]) -> str:
        """The string with one of the characters of each choice whose letter trigrams are the commonest: the best path over pairs of characters."""
        paths = {"^": (0.0, "")}
        for options in [*choices, "$"]:
            new: dict[str, tuple[float, str]] = {}
            for pair, (score, made) in paths.items():
                for c in options:
                    value = score + (float(self.trigrams[xxhash.xxh3_64_intdigest(pair + c) % TRIGRAMS]) if len(pair) == 2 else 0.0)
                    kept = new.get((pair + c)[-2:])
                    if kept is None or value > kept[0]:
                        new[(pair + c)[-2:]] = (value, made + c)
            paths = new
        return max(paths.values())[1][:-1]


def word_counts(texts: DataFrame) -> DataFrame:
    """``(word, n)`` over all texts, counted in the tasks before they are shuffled."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch.text:
                if text:
                    counts.update(WORDS.findall(text.lower()))
            if len(counts) > 500_000:
                yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})
                counts = Counter()
        if counts:
            yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})

    return texts.select("text").mapInPandas(rows, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def learn(texts: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """The lexicon of texts that were not scanned: ``(word, n, strokes)`` of every word, and ``TRIGRAMS`` counts of letter trigrams.

    All words are kept, as a table; only the counts of trigrams, which have a fixed size, leave the executors.
    """
    words = cut(word_counts(texts).withColumn("strokes", strokes_of(F.col("word"))))

    def trigram_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(TRIGRAMS, np.int64)
        for batch in batches:
            for w in batch.word:
                framed = f"^{w}$"
                for k in range(len(framed) - 2):
                    counts[xxhash.xxh3_64_intdigest(framed[k : k + 3]) % TRIGRAMS] += 1
        at = np.flatnonzero(counts)
        yield pd.DataFrame({"slot": at, "n": counts[at]})

    trigrams = np.zeros(TRIGRAMS, np.int64)
    grams = words.select("word").mapInPandas(trigram_rows, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    trigrams[grams.slot.to_numpy()] = grams.n.to_numpy()
    return words, trigrams


def confusions(seen: str, right: str) -> int | None:
    """The least number of confusions by which ``right`` is read as ``seen``; None if it cannot be."""
    at: list[dict[int, int]] = [{} for _ in range(len(seen) + 1)]
    at[0][0] = 0
    for i in range(len(seen)):
        for j, cost in at[i].items():
            steps = [(1, 1, cost)] if right[j : j + 1] == seen[i] else []
            for size in (1, 2):
                steps += [(size, len(r), cost + 1) for r in INTO.get(seen[i : i + size], ()) if i + size <= len(seen) and right.startswith(r, j)]
            for size, width, total in steps:
                if at[i + size].get(j + width, total + 1) > total:
                    at[i + size][j + width] = total
    return at[-1].get(len(right))


class Decoder:
    """Reads words out of the character stream of a page: kept, confused, hyphenated, split or merged."""

    def __init__(self, lexicon: Excerpt):
        self.lexicon, self._read, self._priced = lexicon, {}, {}

    def known(self, word: str) -> bool:
        return word in self.lexicon.counts

    def cost(self, word: str) -> float:
        return self.lexicon.bits + (1 - self.lexicon.level(word) if self.known(word) else UNKNOWN)

    def number(self, token: str) -> str | None:
        """The number a token with digits and letters like digits stands for; case tells 8 (B) from 6 (b)."""
        if not any(c.isdigit() for c in token) or NUMERIC.match(token) or self.known(token.lower()):
            return None
        digits, marks = sum(c.isdigit() for c in token), sum(c in ".,:/-" for c in token)
        number = token.translate(DIGITS)
        return number if NUMERIC.match(number) and digits * 2 >= len(token) - marks else None

    def token(self, core: str) -> str:
        """The best reading of a token as it is printed, in lower case."""
        return self.number(core) or self.read(core.lower())

    def read(self, word: str) -> str:
        """The best reading of a lower-case word."""
        found = self._read.get(word)
        if found is None:
            if len(self._read) > 300_000:
                self._read.clear()
            found = self._read[word] = self._best(word)
        return found

    def _best(self, word: str) -> str:
        if not word or NUMERIC.match(word) or self.known(word):
            return word
        odd = not all(c.isalpha() or c in "-'’" for c in word)
        if re.search(r"[/@_]|\w\.\w", word) and not NUMERIC.match(word.translate(DIGITS)):
            return "".join(p if len(p) < 3 or p.isdigit() else self.read(p) for p in re.split(r"([-./@_:])", word))
        if len(word) < 3 and not (odd and any(c.isalpha() for c in word)):
            return word
        best, least = word, UNKNOWN
        for other, confused in self.lexicon.near(word, max(1, len(word) // 2)):
            if len(other) > 1 and (cost := CONFUSED * confused - self.lexicon.level(other)) < least:
                best, least = other, cost
        if best != word:
            return best
        if "-" in word.strip("-"):
            return "-".join(self.read(p) for p in word.split("-"))
        if odd and sum(c.isalpha() for c in word) >= 3 and not re.search(r"\d{2}", word):
            # A name nobody else writes, with a digit or bar among its letters: the likeliest letters.
            swaps = ["".join(r for r in INTO.get(c, ()) if len(r) == 1 and r.isalpha()) if not c.isalpha() and c not in "-'’" else c for c in word]
            if all(swaps):
                return self.lexicon.likeliest(swaps)
        return word

    def joined(self, left: str, right: str) -> str:
        """The word of two halves around a hyphen at a line's end."""
        whole, kept = left + right, f"{left}-{right}"
        a, b = self.lexicon.level(whole), self.lexicon.level(kept)
        if a or b:
            return whole if a >= b else kept
        for other in (self.read(whole), self.read(kept)):
            if self.known(other):
                return other
        if "-" in left and self.known(f"{self.read(left)}") and self.known(self.read(right)):
            return f"{self.read(left)}-{self.read(right)}"
        return self.read(whole)

    def priced(self, core: str) -> tuple[float, tuple[str, ...]]:
        """The cheapest words a token alone stands for: one, read with or without confusions, or two that were run together."""
        found = self._priced.get(core)
        if found is None:
            if len(self._priced) > 300_000:
                self._priced.clear()
            word = self.token(core)
            low = core.lower()
            found = (0.0 if NUMERIC.match(word) or not word else self.cost(word) + (CONFUSED if word != low else 0.0), (word,))
            if low.isalpha() and not self.known(low):
                for k in range(2, len(low) - 1):
                    if self.known(low[:k]) and self.known(low[k:]):
                        found = min(found, (self.cost(low[:k]) + self.cost(low[k:]) + BLANK, (low[:k], low[k:])))
            self._priced[core] = found
        return found

    def decode(self, tokens: list[Token]) -> list[tuple[int, int, str, tuple[str, ...]]]:
        """The cheapest reading of a stream of tokens, ``(first, behind, kind, words)`` in order.

        A lattice over the places between tokens: an arc reads one token (see ``priced``), two that
        a blank tore apart, if their letters together are a known word and one of them alone is not,
        or two that a hyphen at a line's end parts. The best path is found for the whole stream, so
        that readings which overlap compete.
        """
        n = len(tokens)
        best, back = [0.0] + [math.inf] * n, [None] * (n + 1)
        for i, (_, _, core, tail, broken) in enumerate(tokens):
            cost, words = self.priced(core)
            if best[i] + cost + (2 * UNKNOWN if broken else 0.0) < best[i + 1]:
                best[i + 1], back[i + 1] = best[i] + cost + (2 * UNKNOWN if broken else 0.0), (i, "word", words)
            if i + 1 == n:
                continue
            _, head, right, _, _ = tokens[i + 1]
            if broken:
                if right and right[0].isalnum() and not head:
                    whole = self.joined(core.lower(), right.lower())
                    if best[i] + self.cost(whole) < best[i + 2]:
                        best[i + 2], back[i + 2] = best[i] + self.cost(whole), (i, "hyphen", (whole,))
            elif _torn(tokens[i], tokens[i + 1]):
                whole = (core + right).lower()
                if self.known(whole) and not (self.known(core.lower()) and self.known(right.lower())) and best[i] + self.cost(whole) + BLANK < best[i + 2]:
                    best[i + 2], back[i + 2] = best[i] + self.cost(whole) + BLANK, (i, "merge", (whole,))
        path, at = [], n
        while at:
            i, kind, words = back[at]
            path.append((i, at, kind, words))
            at = i
        return path[::-1]


#: Body line, marks before, letters, marks behind, whether a hyphen at the line's end was taken off.
Token = tuple[int, str, str, str, bool]


def _torn(left: Token, right: Token) -> bool:
    """Whether two tokens may be one word that a blank tore apart: letters only, nothing between them, no name begins in the second."""
    return not left[3] and not right[1] and left[2].isalpha() and right[2].isalpha() and right[2].islower()


def asked_words(streams: Iterator[list[Token]]) -> tuple[set[str], set[str]]:
    """The words a decoder may look up: with all they may stand for, and as they are."""
    alone: set[str] = set()
    parted: set[tuple[str, str]] = set()
    torn: set[str] = set()
    for tokens in streams:
        for k, token in enumerate(tokens):
            alone.add(token[2].lower())
            if k + 1 < len(tokens):
                if token[4]:
                    parted.add((token[2].lower(), tokens[k + 1][2].lower()))
                elif _torn(token, tokens[k + 1]):
                    torn.add((token[2] + tokens[k + 1][2]).lower())
    for left, right in parted:
        alone.update((left + right, f"{left}-{right}", left, right))
    near = set(alone)
    for word in alone:
        if not word.isalpha():
            near.update((*re.split(r"[-./@_:]", word), *word.split("-")))
        else:
            for k in range(2, len(word) - 1):
                torn.update((word[:k], word[k:]))
    return near, torn - near


def _fold(line: str) -> str:
    """Letters of a line, alike for what scanners confuse, without numbers at its end."""
    line = NUMBER_TAIL.sub("", line).lower()
    for seen, right in (("0", "o"), ("1", "l"), ("|", "l"), ("5", "s"), ("6", "b"), ("9", "g"), ("rn", "m"), ("vv", "w"), ("cl", "d"), ("ii", "u"), ("i", "l"), ("c", "e"), ("h", "b")):
        line = line.replace(seen, right)
    return re.sub(r"[\W\d_]+", "", line)


def furniture_lines(lines: list[str], name: str) -> set[int]:
    """Numbers of the lines that are running headers or page numbers.

    A page number stands alone or at a header's end. A header begins a page or ends one: it is
    not filled to the column although the text goes on after it, does not end like a sentence,
    and usually comes again, names the file, or is set in capitals.
    """
    filled = [n for n, line in enumerate(lines) if line.strip()]
    if not filled:
        return set()
    column = sorted(len(lines[n]) for n in filled if not NUMBER_TAIL.search(lines[n])) or [0]
    width = column[int(0.97 * (len(column) - 1))]
    def label(n: int) -> bool:
        """A line of one word, as stands above a figure of the text."""
        return n >= 0 and bool(re.fullmatch(r"[^\W\d_]+:?", lines[n].strip())) and not NUMBER_LINE.match(lines[n])

    numbers = {n for n in filled if NUMBER_LINE.match(lines[n]) and not label(n - 1)}
    tails = {n for n in filled if n not in numbers and NUMBER_TAIL.search(lines[n]) and not lines[n].strip()[:1].islower() and not lines[n].startswith("|")}
    out = numbers | tails
    folds = Counter(_fold(lines[n]) for n in filled if n not in numbers)
    title = _fold(re.sub(r"(_\d+)?\.\w+$", "", name or "").replace("_", " "))
    for i, n in enumerate(filled):
        line = lines[n].strip()
        if n in out or label(n) or len(line) > 100 or line.startswith("|") or NUMBER_LINE.match(line):
            continue
        if line[-1] in ENDS or line[-1] in HYPHENS or line[-1] in "\"'”’»)]" or line[:1].islower() or re.match(r"^(?:[-*•]|\d+[.)])\s", line):
            continue
        fold = _fold(line)
        letters = [c for c in line if c.isalpha()]
        capitals = len(letters) > 3 and sum(c.isupper() for c in letters) > 0.8 * len(letters)
        later = next((m for m in filled[i + 1 :] if m not in out), None)
        after = lines[later].split()[0] if later is not None else ""
        blank = later is None or any(not lines[m].strip() for m in range(n + 1, later))
        room = len(line) + 1 + len(after) < width - 2
        named = bool(title) and len(fold) > 3 and (fold == title or (len(title) > 8 and fold.endswith(title)))
        if named or capitals or (folds[fold] > 1 and len(fold) > 5 and len(line) < 0.9 * width + 4) or (room and not blank) or (i == 0 and room):
            out.add(n)
    return out


def paragraphs(body: list[tuple[int, str]], width: int, usual: tuple[float, float] = USUAL) -> list[list[int]]:
    """Indexes of the body lines by paragraph; boundaries that cost least in all, found by dynamic programming.

    A boundary is cheap where lines were left blank or end a sentence short of the column; it is
    not set inside a sentence that goes on. What a paragraph costs besides depends on its length:
    half the squared distance of the logarithm of its characters from ``usual``, the mean and
    deviation in texts whose paragraphs are known. So the same hints part a long run of lines and
    leave a short one whole.
    """
    n = len(body)
    edges, prices = [0], [0.0]
    for k in range(1, n):
        (before_no, before), (after_no, after) = body[k - 1], body[k]
        ended = before.rstrip("\"'”’»)]")[-1:] in ".!?…:。！？।"
        blank = after_no > before_no + 1
        if before[-1:] in HYPHENS or after[:1].islower() or not (ended or blank):
            continue
        edges.append(k)
        prices.append((-1.0 if ended else 2.0) + (-3.0 if blank and ended else -1.0 if blank else 0.0) + (-2.0 if ended and len(before) < 0.6 * width else 0.0) + 2.0)
    edges.append(n)
    if not n:
        return []
    starts = np.array(edges)
    chars = np.cumsum([0, *(len(line) + 1 for _, line in body)])[starts]
    price = np.array(prices)
    best, back = np.full(len(edges), np.inf), np.zeros(len(edges), int)
    best[0] = 0.0
    for k in range(1, len(edges)):
        length = (np.log(chars[k] - chars[:k]) - usual[0]) / usual[1]
        total = best[:k] + price[:k] + length**2 / 2
        back[k] = int(np.argmin(total))
        best[k] = total[back[k]]
    out, k = [], len(edges) - 1
    while k:
        out.append(list(range(edges[back[k]], edges[k])))
        k = back[k]
    return out[::-1]


def paragraph_lengths(texts: DataFrame) -> tuple[float, float]:
    """Mean and deviation of the logarithm of a paragraph's characters, over all paragraphs of texts that were not scanned."""
    parts = texts.select(F.explode(F.split("text", r"\n\s*\n")).alias("p")).select(F.log(F.length(F.trim("p")).cast("double")).alias("l")).filter("l is not null")
    r = parts.agg(F.avg("l").alias("mean"), F.stddev("l").alias("spread")).first()
    return (r["mean"], max(r["spread"], 0.2)) if r["spread"] is not None and not math.isnan(r["spread"]) else USUAL


EDGE = re.compile(r"^[\"'“”„‘’«»(\[{]*|[\"'“”‘’«»)\]}.,;:!?…]*$")


def _core(token: str) -> tuple[str, str, str]:
    head = re.match(r"^[\"'“”„‘’«»(\[{]*", token).end()
    tail = re.search(r"[\"'“”‘’«»)\]}.,;:!?…]*$", token[head:]).start() + head
    return token[:head], token[head:tail], token[tail:]


def _cased(like: str, word: str) -> str:
    letters = [c for c in like if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return word.upper()
    return word[:1].upper() + word[1:] if like[:1].isupper() else word


def stream(text: str, gone: set[int]) -> tuple[list[Token], list[tuple[int, str]], list[int]]:
    """The tokens of a text without the lines that are ``gone``, its body lines (numbered without them) and their numbers in the text."""
    body, numbers, gap = [], [], 0
    for n, line in enumerate(text.split("\n")):
        if n in gone:
            gap += 1
        elif line.strip():
            body.append((n - gap, line.strip()))
            numbers.append(n)
    tokens: list[Token] = []
    for k, (_, line) in enumerate(body):
        raw = line.split()
        broken = len(raw[-1]) > 1 and raw[-1][-1] in HYPHENS and raw[-1][-2].isalnum() and k + 1 < len(body)
        if broken:
            raw[-1] = raw[-1][:-1]
        tokens += [(k, *_core(token), False) for token in raw[: len(raw) - broken]]
        if broken:
            tokens.append((k, *_core(raw[-1]), True))
    return tokens, body, numbers


def _read(text: str, gone: set[int], decoder: Decoder) -> tuple[list[tuple[int, str, str]], list[tuple[int, str]], list[tuple[int, str]]]:
    """Findings, body lines and ``(body line, word)`` of a text without the lines that are ``gone``."""
    tokens, body, numbers = stream(text, gone)
    findings = [(n, "furniture", "") for n in sorted(gone)]
    words: list[tuple[int, str]] = []
    for first, behind, kind, made in decoder.decode(tokens):
        k, head, core, _, broken = tokens[first]
        tail = tokens[behind - 1][3]
        if kind == "hyphen":
            findings.append((numbers[k], "hyphen", made[0]))
            words.append((k, head + _cased(core, made[0]) + tail))
        elif kind == "merge":
            words.append((k, head + _cased(core, made[0]) + tail))
        else:
            shown = core
            if len(made) > 1:
                shown = " ".join((_cased(core, made[0]), *made[1:]))
            elif made[0] != core.lower():
                findings.append((numbers[k], "misread", made[0]))
                shown = _cased(core, made[0])
            words.append((k, head + shown + tail + ("-" if broken else "")))
    return findings, body, words


def repair(text: str, name: str, decoder: Decoder, gone: set[int] | None = None, usual: tuple[float, float] = USUAL) -> tuple[list[tuple[int, str, str]], list[str]]:
    """Findings ``(line, kind, repaired)`` and the repaired paragraphs of one scanned text."""
    findings, body, words = _read(text, furniture_lines(text.split("\n"), name) if gone is None else gone, decoder)
    width = max((len(line) for _, line in body), default=0)
    by_line: dict[int, list[str]] = {}
    for k, w in words:
        by_line.setdefault(k, []).append(w)
    merged = [" ".join(w for k in part for w in by_line.get(k, ())) for part in paragraphs(body, width, usual)]
    return findings, [m for m in merged if m]


def _scans(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = documents.select("doc_id", F.col("full_text").alias("text"), F.col("original_filename").alias("name")).filter("doc_id is not null and text is not null")
    scan = is_scan(F.col("text"))
    return rows.filter(scan).groupBy("doc_id").agg(F.max(F.struct("text", "name")).alias("r")).select("doc_id", "r.text", "r.name"), rows.filter(~scan).select("text")


def _repaired(documents: DataFrame, schema: str, findings: bool) -> DataFrame:
    """The scans in blocks, each read with the words of the lexicon that it may look up."""
    scans, clean = _scans(documents)
    words, counts = learn(clean)
    trigrams = documents.sparkSession.sparkContext.broadcast(counts)
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    usual = USUAL if findings else paragraph_lengths(clean)

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            gone = [sorted(furniture_lines(t.split("\n"), n or "")) for t, n in zip(batch.text, batch.name)]
            yield pd.DataFrame({"doc_id": batch.doc_id, "text": batch.text, "gone": gone})

    def asks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, part in batch.groupby("block"):
                near, exact = asked_words(stream(text, set(gone))[0] for text, gone in zip(part.text, part.gone))
                yield pd.DataFrame({"block": block, "word": [*near, *exact], "exact": [False] * len(near) + [True] * len(exact)})

    def rows(texts: pd.DataFrame, excerpt: pd.DataFrame) -> pd.DataFrame:
        decoder = Decoder(Excerpt(dict(zip(excerpt.word, excerpt.n.tolist())), trigrams.value, total))
        out = []
        for doc, text, gone in zip(texts.doc_id, texts.text, texts.gone):
            if findings:
                out += [(doc, *f) for f in _read(text, set(gone), decoder)[0]]
            else:
                out += [(doc, n, p) for n, p in enumerate(repair(text, "", decoder, set(gone), usual)[1])]
        return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    found = cut(scans.mapInPandas(pages, "doc_id string, text string, gone array<int>"))
    blocks = -(-found.count() // BLOCK) or 1
    texts = found.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))
    asked = cut(texts.select("block", "text", "gone").mapInPandas(asks, "block int, word string, exact boolean"))
    near = asked.filter("not exact").select("block", strokes_of(F.col("word")).alias("strokes")).distinct().join(words, "strokes")
    exact = asked.filter("exact").select("block", "word").distinct().join(words, "word")
    excerpts = near.select("block", "word", "n").unionByName(exact.select("block", "word", "n"))
    return texts.groupBy("block").cogroup(excerpts.groupBy("block")).applyInPandas(rows, schema)


def scan_defects(documents: DataFrame) -> DataFrame:
    """Defects of the scanned texts: ``(doc_id, line_no, kind, repaired)``, distinct.

    ``documents``: ``doc_id, full_text, original_filename``. Whether a text was scanned is read
    from its lines. Furniture lines are set aside; the others are one stream, decoded as a whole
    (see ``Decoder.decode``): words broken at line and page ends or torn by blanks are joined, words
    run together are parted, and each word the corpus does not know is read as the likeliest known
    one its characters may stand for. Null and empty texts and null ids
    give no rows; repeated rows of an id count once; an empty table gives an empty table.
    """
    return _repaired(documents, FINDING, True).distinct()


def scan_paragraphs(documents: DataFrame) -> DataFrame:
    """The scanned texts as continuous paragraphs of whole words: ``(doc_id, paragraph_no, text)``; see ``scan_defects``."""
    return _repaired(documents, PARAGRAPH, False)
