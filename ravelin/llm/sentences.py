"""Sentence boundaries across languages and scripts: candidates classified by maximum entropy."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

SENTENCE = "doc_id long, sent_start int, sent_end int"
SAMPLE_DOCUMENTS = 2000
SAMPLE_CHARACTERS = 20_000
COUNT_SLOTS = 1 << 19
WEIGHTS = 1 << 17

#: Marks that open and close a quotation or bracket.
PAIRS = {"(": ")", "（": "）", "[": "]", "【": "】", "«": "»", "「": "」", "『": "』", "“": "”", "„": "“", "《": "》"}
CLOSERS = "".join(sorted({*PAIRS.values(), '"', "”"}))
MARKS = re.compile("[" + re.escape("".join({*PAIRS, *PAIRS.values(), '"'})) + "]")
ASKING = frozenset("?؟？" + CLOSERS)
WIDE = "。！？｡"
WIDE_MARKS, OPEN_ENDED = frozenset(WIDE), frozenset(WIDE + "।")
MARKER = re.compile(r"^\s*(?:[-*•–·▪]\s+|\(?\d{1,3}[.)]\s+|\(?[a-zA-Z][)]\s+|[一二三四五六七八九十]+、)(?=\S)")
CANDIDATE = re.compile(r"(?:[.!?…۔؟।॥。！？｡]|(?<=[Ͱ-Ͽἀ-῿]);)+")
GLUED = re.compile(r"[^\W\d_A-ZÀ-Þ]\.([^\W\d_a-zß-ÿ]\w*)$")
LOWER = re.compile(r"\s+[a-zß-öø-ÿα-ωάέήίόύώа-яё](?![A-Z])")
BLANK = re.compile(r"\n\s*\n")
SOLID = re.compile(r"\S")
#: Characters of the text beside a mark that its features are read from.
WINDOW = 60
TOKEN = re.compile(r"[^\s\"“”„«»「」『』()（）\[\]]+")


def composed(token: str) -> str:
    """The token with letters and accents in one, so that both ways of writing them have the same features."""
    return token if token.isascii() else unicodedata.normalize("NFC", token)


def _script(c: str) -> str:
    o = ord(c)
    if 0x0E00 <= o <= 0x0E7F:
        return "thai"
    if 0x3040 <= o <= 0x30FF or 0x3400 <= o <= 0x9FFF or 0xF900 <= o <= 0xFAFF:
        return "wide"
    if 0x0370 <= o <= 0x03FF or 0x1F00 <= o <= 0x1FFF:
        return "greek"
    if 0x0400 <= o <= 0x052F:
        return "cyrillic"
    if 0x0600 <= o <= 0x06FF:
        return "arabic"
    if 0x0900 <= o <= 0x097F:
        return "nagari"
    return "latin" if c.isalpha() else "digit" if c.isdigit() else "mark"


def matched(text: str) -> dict[int, int]:
    """Positions of opening marks with those of their closing ones; marks without a partner are left out.

    A straight quotation mark opens or closes by the blanks beside it; one that can only open takes
    the place of one still open, which so has no partner. A closing mark drops what stands open
    inside its pair. Every mark is put on the stack and taken off once.
    """
    stack: list[tuple[str, int]] = []
    waiting: Counter[str] = Counter()
    out: dict[int, int] = {}
    for m in MARKS.finditer(text):
        i, c = m.start(), m.group()
        if c == '"':
            after = text[i + 1 : i + 2]
            opens = after and not after.isspace()
            only = opens and (i == 0 or text[i - 1].isspace()) and after.isalnum()
            if stack and stack[-1][0] == '"':
                start = stack.pop()[1]
                if only:
                    stack.append(('"', i))
                else:
                    out[start] = i
            elif opens:
                stack.append(('"', i))
        elif waiting[c]:
            while True:
                closer, start = stack.pop()
                if closer != '"':
                    waiting[closer] -= 1
                if closer == c:
                    break
            out[start] = i
        elif c in PAIRS:
            stack.append((PAIRS[c], i))
            waiting[PAIRS[c]] += 1
    return out


def shape(token: str) -> str:
    if not token:
        return "none"
    c = token[0]
    if c.isdigit():
        return "digit"
    if not c.isalpha():
        return "mark"
    if c.islower():
        return "camel" if len(token) > 1 and token[1].isupper() else "lower"
    if c.isupper():
        letters = token.rstrip(".,;:!?")
        return "initial" if len(letters) == 1 and token[1:2] == "." else "letter" if len(letters) == 1 else "upper"
    return _script(c)


@dataclass(slots=True)
class Candidate:
    end: int
    mark: str
    left: str
    before: str
    after: str
    spaced: bool
    closed: str


def candidates(text: str, sure: bool = True) -> list[Candidate]:
    """Places where a sentence of running text may end, none inside a quotation or bracket.

    Without ``sure``, places that a word in small letters follows are left out: they are sure
    non-boundaries, which only training needs.
    """
    pairs = matched(text)
    closing = {b: a for a, b in pairs.items()}
    outer: list[tuple[int, int]] = []
    for a, b in sorted(pairs.items()):
        if not outer or a > outer[-1][1]:
            outer.append((a, b))
    starts = [a for a, _ in outer]
    size = len(text.rstrip())
    found: dict[int, Candidate] = {}

    def put(mark_at: int, mark: str, end: int) -> None:
        closed = ""
        while end < size:
            skip = end
            if text[skip] in "\u00a0\u202f " and text[skip + 1 : skip + 2] == "»" and skip + 1 in closing:
                skip += 1
            if skip in closing:
                opened = closing[skip]
                lead = text[max(0, opened - 40) : opened].rstrip()
                place = "start" if not lead or lead[-1] in ".!?…؟।。！？" + CLOSERS else "colon" if lead[-1] in ":：" else "inner"
                closed = place + ("b" if text[skip] in ")）]】" else "q")
                end = skip + 1
            elif text[end] in ".!?…" and closed:
                end += 1
            else:
                break
        at = bisect_right(starts, mark_at) - 1
        if end >= size or (at >= 0 and outer[at][0] < mark_at < outer[at][1] and end <= outer[at][1]):
            return
        head = text[max(0, mark_at - WINDOW) : mark_at].split()
        tokens = TOKEN.findall(head[-1]) if head else []
        left = tokens[-1] if tokens else ""
        if "." in left and (run := GLUED.search(left)):
            left = run.group(1)
        before = head[-2] if len(head) > 1 else ""
        begins = SOLID.search(text, end).start()
        token = TOKEN.match(text, begins, begins + WINDOW)
        after = token.group() if token else text[begins]
        # Scripts without spaces have clauses for tokens; what counts of those is the character at the boundary.
        left = left[-1:] if left and left[-1] > "⿿" and _script(left[-1]) == "wide" else left
        after = after[:1] if after and after[0] > "⿿" and _script(after[0]) == "wide" else after
        found[end] = Candidate(end, mark, composed(left.lower() if not (len(left) == 1 and left.isupper()) else left), before, composed(after), text[end].isspace(), closed)

    for m in CANDIDATE.finditer(text):
        at, end, mark = m.start(), m.end(), m.group()
        nxt = text[end : end + 1]
        if not nxt:
            continue
        if not sure and nxt.isspace() and LOWER.match(text, end):
            continue
        plain = mark == "."
        if not (nxt.isspace() or nxt in CLOSERS) and OPEN_ENDED.isdisjoint(mark):
            if nxt in ",;:)-'’/@_" or nxt.isdigit() or nxt.islower() or (plain and not (nxt.isupper() and at > 1 and (text[at - 1].islower() and text[at - 2] != "." or text[at - 1].isdigit() and text[end + 1 : end + 2].islower()))):
                continue
            if set(mark) <= {"…"}:
                continue
            word = (text[max(0, at - 80) : at].split() or [""])[-1] + text[at : at + 80].split()[0]
            if plain and re.search(r"[@/_]", word):
                continue
        put(at, mark if mark == "." else "wide" if not WIDE_MARKS.isdisjoint(mark) else "ellipsis" if mark in ("…", "...", "....") or set(mark) == {"…"} else mark[-1], end)
    for m in re.finditer(r"(?<=[฀-๿])[ \n]+(?=[^\W\d])", text):
        put(m.start(), "gap", m.start())
    return [found[k] for k in sorted(found)]


def structure(text: str) -> list[tuple[int, int, bool]]:
    """Blocks ``(start, end, whole)``: running text, or a heading or list item that stays whole."""
    out: list[tuple[int, int, bool]] = []
    for block in re.finditer(r"\S(?:[^\n]|\n(?![ \t\r\f\v  ]*\n))*", text):
        base, lines, at = block.start(), [], 0
        for line in block.group().split("\n"):
            lines.append((base + at, line))
            at += len(line) + 1
        width = max(len(line) for _, line in lines)
        wrapped = len(lines) > 2 and width < 110
        start, kind = lines[0][0], None
        for n, (pos, line) in enumerate(lines):
            bare = line.strip()
            above = lines[n - 1][1].strip() if n else ""
            ended = not above or above.rstrip(CLOSERS)[-1:] in ".!?…؟।;:。！？"
            below = lines[n + 1][1].strip() if n + 1 < len(lines) else ""
            item = bool(MARKER.match(line)) and (n == 0 or kind in ("item", "heading") or ended)
            full = wrapped and bool(below) and len(line.rstrip()) + 1 + len(below.split()[0]) > width - 1
            first = bare[:1]
            small = first.islower() and not bare[1:2].isupper()
            head = 1 if any(_script(c) == "wide" for c in bare[:3]) else len(bare.split()[0]) if bare else 0
            open_end = bare.rstrip(CLOSERS)[-1:] not in ".!?…,;؟।:。！？、，—" and bare[-1:] not in ".!?,;:。！？"
            thai = bool(bare) and _script(bare[-1]) == "thai"
            heading = bool(below) and (n == 0 or kind == "heading") and not item and open_end and not full and len(bare) < 90 and not (below[:1].islower() and not below[1:2].isupper()) and bool(first) and (not thai or " " not in bare) and not re.search(r"[.!?]\s+\w", bare) and not (re.search(r"[。！？।؟]", bare))
            if n and (item or kind == "heading" or (kind == "item" and not (above and not item and small) and not (wrapped and len(above) + 1 + head > width))):
                out.append((start, lines[n - 1][0] + len(lines[n - 1][1]), kind is not None))
                start, kind = pos, None
            if item:
                kind = "item"
            elif heading and start == pos:
                kind = "heading"
            elif kind == "heading":
                kind = None
        if kind is None and len(lines) == 1 and lines[0][1].strip()[-1:] not in ".!?…؟।;。！？" and len(lines[0][1]) < 60 and not re.search(r"[.!?؟।。！？]\s", lines[0][1]) and not re.search(r"[฀-๿] ", lines[0][1]):
            kind = "heading"
        out.append((start, block.end(), kind is not None))
    return out


def _slot(kind: str, token: str) -> int:
    return xxhash.xxh3_64_intdigest(kind + token) % COUNT_SLOTS


@dataclass
class Counts:
    """How often words end and begin paragraphs, stand before a period, before a period and a number, behind a question, before a number and a period, and stand anywhere; in fixed space."""

    table: np.ndarray
    classes: dict[str, tuple] = field(default_factory=dict)

    def key(self, c: Candidate) -> tuple:
        """All that the features of a candidate depend on; of the word behind it only its classes."""
        after = self.classes.get(c.after)
        if after is None:
            if len(self.classes) > 300_000:
                self.classes.clear()
            after = self.classes[c.after] = (shape(c.after), self.starts(c.after), _script(c.after[0]) if c.after else "")
        return c.mark, c.left, context(c, self), after, c.spaced, c.closed

    def of(self, kind: str, token: str) -> int:
        return int(self.table[_slot(kind, token)])

    def ends(self, left: str) -> str:
        n, last = self.of("p", left), self.of("e", left)
        return "rare" if n < 8 else "never" if last * 400 < n else "seldom" if last * 33 < n else "often"

    def leads(self, left: str) -> bool:
        """Whether a word is one that stands before what it names or counts: hardly ever without its period, or often with a number behind that, and hardly ever at a paragraph's end. Long words need more evidence."""
        n = self.of("p", left)
        return n >= 5 << max(0, len(left) - 4) and self.of("e", left) * 33 < n and (self.of("d", left) * 4 > n or self.of("w", left) * 4 < n * 5)

    def answers(self, left: str) -> bool:
        """Whether a word with a period is often all that stands behind a question."""
        n = self.of("q", left)
        return n >= 3 and n * 20 > self.of("p", left)

    def ordinal(self, before: str) -> bool:
        """Whether a word stands before a number and a period, as before an ordinal, more often than numbers do at a paragraph's end."""
        n = self.of("o", before)
        return n >= 5 and self.of("l", before) * 33 < n

    def starts(self, after: str) -> str:
        token = after.rstrip(".,;:!?")
        n, first = self.of("w", token), self.of("s", token)
        return "rare" if n < 8 else "never" if not first else "some"

    def dotted(self, left: str) -> str:
        n, dots = self.of("w", left), self.of("p", left)
        return "rare" if n < 4 else "mostly" if dots * 10 > n * 9 else "half" if dots * 2 > n else "less"


def context(c: Candidate, counts: Counts) -> str:
    """What the word before the last one says: an abbreviation, a question that the last word answers, an ordinal's article."""
    before, left = c.before, c.left
    if left[:1].isdigit():
        if counts.ordinal(before.lower()):
            return "ordinal"
    elif before and before[-1] in ASKING and before.rstrip(CLOSERS)[-1:] in ("?", "؟", "？") and left.isalpha() and counts.answers(left):
        return "answer"
    return "chain" if before.endswith(".") else "plain"


def features(c: Candidate, counts: Counts) -> list[int]:
    left, after = shape(c.left), shape(c.after)
    ends, starts, dotted = counts.ends(c.left), counts.starts(c.after), counts.dotted(c.left)
    chain = context(c, counts)
    lead = "leading" if c.mark == "." and counts.leads(c.left) else "other"
    size = "dots" if "." in c.left.strip(".") else str(min(len(c.left), 5))
    script = f"{_script(c.left[-1]) if c.left else ''}>{_script(c.after[0]) if c.after else ''}"
    mark = "." if c.mark == "." else "strong" if c.mark in "!?؟।॥;wide۔" else c.mark
    named = [
        f"m={mark}", f"m={mark}|a={after}", f"m={mark}|sp={c.spaced}", f"m={mark}|c={c.closed}", f"c={c.closed}|a={after}", f"c={c.closed}|sp={c.spaced}|{script}",
        f"{mark}|l={left}|n={size}", f"{mark}|{lead}", f"{mark}|{lead}|a={after}", f"{mark}|e={ends}|a={after}", f"{mark}|e={ends}|n={size}", f"{mark}|s={starts}|l={left}",
        f"{mark}|d={dotted}|a={after}", f"{mark}|{chain}|n={size}|l={left}", f"{mark}|{chain}|a={after}|n={size}", f"{mark}|L={c.left}", f"{mark}|L={c.left}|a={after}", f"{mark}|{script}",
    ]
    return [xxhash.xxh3_64_intdigest(f) % WEIGHTS for f in named]


def reliable(c: Candidate, counts: Counts) -> int | None:
    """1 for a sure boundary inside a paragraph, 0 for a sure non-boundary, None where it must be learnt."""
    after, left = shape(c.after), shape(c.left)
    if c.mark == "gap":
        return 1
    if c.mark == "wide":
        if not c.closed:
            return 1
        return 1 if c.closed == "colonq" else 0
    if c.closed == "innerb":
        return 0
    if after == "lower" or (after == "mark" and c.after[0] in ",;:—–-"):
        return 0
    if c.mark == "ellipsis":
        return None
    if c.mark in "!?؟।॥;۔":
        return 1 if after in ("upper", "digit", "camel", "letter", "initial") or c.mark in "؟।;" else None
    if c.before and c.before.rstrip(CLOSERS)[-1:] in "?؟？" and after in ("upper", "camel") and c.left.isalpha() and len(c.left) > 1 and counts.answers(c.left):
        return 1
    if counts.leads(c.left):
        return 0
    if after == "digit" and counts.ends(c.left) == "never" and counts.dotted(c.left) == "mostly":
        return 0
    if c.left and _script(c.left[-1]) == "nagari" and after == "nagari":
        return 0  # the script has a full stop of its own
    if left == "digit" and counts.ordinal(c.before.lower()):
        return 0
    if left == "letter" and c.before.endswith("."):
        return 0
    if after == "initial" and left in ("letter", "initial"):
        return 0
    if len(c.left) > 3 and c.left.isalpha() and counts.dotted(c.left) in ("less", "half") and after in ("upper", "camel", "letter"):
        return 1
    return None


@dataclass
class Model:
    weights: np.ndarray
    counts: Counts
    known: dict[tuple, float] = field(default_factory=dict)

    def probability(self, c: Candidate) -> float:
        key = self.counts.key(c)
        if key not in self.known:
            if len(self.known) > 300_000:
                self.known.clear()
            self.known[key] = float(1 / (1 + np.exp(-self.weights[features(c, self.counts)].sum())))
        return self.known[key]


def train(texts: list[str], counts: Counts, epochs: int = 8, rate: float = 0.15, decay: float = 1e-5) -> Model:
    """Maximum entropy on the reliable boundaries of the texts.

    Boundaries: the ends of paragraphs, each with the beginning of the next one as what comes
    after, and the sure ones inside. Non-boundaries: the sure ones.
    """
    seen: Counter[tuple[tuple, int]] = Counter()
    kept: dict[tuple, list[int]] = {}

    def add(c: Candidate, label: int) -> None:
        key = counts.key(c)
        if key not in kept:
            kept[key] = features(c, counts)
        seen[key, label] += 1

    for text in texts:
        blocks = [text[a:b] for a, b, whole in structure(text) if not whole]
        for one, following in zip(blocks, blocks[1:]):
            # The end of a paragraph becomes an ordinary candidate when the next one is set behind it.
            joined = f"{one.strip()} {following.lstrip()[:60]}"
            size = len(one.strip())
            for c in candidates(joined):
                if c.end == size and joined[size - 1] in ".!?…؟।;。！？" + CLOSERS:
                    add(c, 1)
        for block in blocks:
            for c in candidates(block):
                if (label := reliable(c, counts)) is not None:
                    add(c, label)
    weights = np.zeros(WEIGHTS)
    if seen:
        # Equal candidates are one weighted row.
        x, y = np.array([kept[key] for key, _ in seen]), np.array([label for _, label in seen], float)
        times, power = np.array(list(seen.values()), float), np.full(WEIGHTS, 1e-3)
        rng = np.random.default_rng(3)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(y), 512):
                pick = order[at : at + 512]
                p = 1 / (1 + np.exp(-weights[x[pick]].sum(axis=1)))
                grad = np.bincount(x[pick].ravel(), np.repeat((p - y[pick]) * np.minimum(times[pick], 20), x.shape[1]), WEIGHTS) + decay * weights
                power += grad**2
                weights -= rate * grad / np.sqrt(power)
    return Model(weights, counts)


def sentences(text: str, model: Model) -> list[tuple[int, int]]:
    """Spans of the sentences of a text, without white space around them; they cover everything else."""
    out = []
    for start, end, whole in structure(text):
        cuts = [] if whole else [start + c.end for c in candidates(text[start:end], sure=False) if model.probability(c) > 0.5]
        at = start
        for cut_at in [*cuts, end]:
            piece = text[at:cut_at]
            bare = piece.strip()
            if bare:
                lead = len(piece) - len(piece.lstrip())
                out.append((at + lead, at + lead + len(bare)))
            at = cut_at
    return out


def boundary_counts(documents: DataFrame) -> Counts:
    """Counts over all documents, added up in the tasks in COUNT_SLOTS slots, which is all that leaves them."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros(COUNT_SLOTS, np.int64)
        for batch in batches:
            words: Counter[str] = Counter()
            first: Counter[str] = Counter()
            last: Counter[str] = Counter()
            counted: Counter[str] = Counter()
            answers: Counter[str] = Counter()
            ordinals: Counter[str] = Counter()
            numbers: Counter[str] = Counter()
            for text in batch.text:
                if not text:
                    continue
                for block in BLANK.split(text):
                    parts = block.split()
                    if parts:
                        words.update(parts)
                        first[parts[0]] += 1
                        last[parts[-1]] += 1
                        counted.update(a for a, b in zip(parts, parts[1:]) if a[-1] == "." and b[0].isdigit())
                        answers.update(b for a, b in zip(parts, parts[1:]) if b[-1] == "." and (a[-1] in "?؟？" or a[-1] in CLOSERS and a.rstrip(CLOSERS)[-1:] in ("?", "؟", "？")))
                        numbered = [a for a, b in zip(parts, parts[1:]) if b[-1] == "." and b[:-1].isdigit()]
                        ordinals.update(numbered)
                        if numbered and parts[-1][:-1].isdigit() and parts[-1][-1] == ".":
                            numbers[parts[-2]] += 1
            for word, n in words.items():
                for token in TOKEN.findall(composed(word)):
                    bare = token.rstrip(".,;:!?…")
                    low = bare if len(bare) == 1 and bare.isupper() else bare.lower()
                    table[_slot("w", bare)] += n
                    if low != bare:
                        table[_slot("w", low)] += n
                    if token.endswith("."):
                        table[_slot("p", low)] += n
            for word, n in first.items():
                if tokens := TOKEN.findall(composed(word)):
                    table[_slot("s", tokens[0].rstrip(".,;:!?"))] += n
            for word, n in last.items():
                if (tokens := TOKEN.findall(composed(word))) and tokens[-1].endswith("."):
                    bare = tokens[-1].rstrip(".")
                    table[_slot("e", bare if len(bare) == 1 and bare.isupper() else bare.lower())] += n
            for kind, seen in (("d", counted), ("q", answers)):
                for word, n in seen.items():
                    if tokens := TOKEN.findall(composed(word)):
                        bare = tokens[-1].rstrip(".,;:!?…")
                        table[_slot(kind, bare if len(bare) == 1 and bare.isupper() else bare.lower())] += n
            for kind, seen in (("o", ordinals), ("l", numbers)):
                for word, n in seen.items():
                    table[_slot(kind, word.lower())] += n
        at = np.flatnonzero(table)
        yield pd.DataFrame({"slot": at, "n": table[at]})

    slots = documents.select("text").mapInPandas(rows, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(COUNT_SLOTS, np.int64)
    table[slots.slot.to_numpy()] = slots.n.to_numpy()
    return Counts(table)


def split_sentences(documents: DataFrame, sample_documents: int = SAMPLE_DOCUMENTS, sample_characters: int = SAMPLE_CHARACTERS) -> DataFrame:
    """The sentences of every document, ``(doc_id, sent_start, sent_end)``, half-open spans of code points.

    ``documents``: ``doc_id, text``. Headings and list items are whole units; in running text
    each place that may end a sentence, outside quotations and brackets, is classified by a
    maximum-entropy model of the words beside it, their case, length and script, and how often
    they end and begin paragraphs anywhere. The counts are of all documents; the model is fitted
    on the reliable boundaries of at most ``sample_documents`` of them, those with the least
    hash of their id among the texts of at most ``sample_characters`` characters.

    Null, empty and blank texts and null ids give no rows; repeated rows give their sentences
    once. A text is one task's work. An empty table gives an empty table.
    """
    rows = documents.select("doc_id", "text").filter("doc_id is not null and text is not null")
    counts = boundary_counts(rows)
    chosen = rows.filter(F.length("text") <= sample_characters).orderBy(F.xxhash64("doc_id"), "text").limit(sample_documents).select("text").collect()
    model = rows.sparkSession.sparkContext.broadcast(train([r.text for r in chosen], counts))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids: list[int] = []
            starts: list[int] = []
            ends: list[int] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for a, b in sentences(text, model.value):
                    ids.append(doc)
                    starts.append(a)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["doc_id", "sent_start", "sent_end"])

    return rows.mapInArrow(spans, SENTENCE).distinct()
