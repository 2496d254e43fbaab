"""License scans: blocks that may hold a notice are compressed with each template as a raw dictionary; the best reductions are confirmed by wording."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from faultlens.llm.common import raw
from faultlens.llm.license_texts import TEMPLATES
from faultlens.llm.substrings import text_batches
from faultlens.session import ship

COVERED = 0.75  # share of a template's words that a block must hold in order
BLOCK = 4  # longest wordings that a block holds at most
PRICES = (0.125, 0.25, 0.5, 1.0)  # of a word put in between, against 1 for a word found

# Words that serve as a sign only where a template has no others.
COMMON = frozenset(b"a an and any are as at be but by can do for from has have if in is it its may no not of on or other shall so such that the this to under use was were will with without you your".split())

# Words that tell one licence from another, wherever a wording has them; words that turn a notice around; words after which reserved rights
# are somebody's bookings; and words that a notice may have nearby instead of inside.
NAMES = frozenset(b"apache mit gnu gpl lgpl agpl general lesser affero library free documentation bsd mpl mozilla cc cc0 by nc nd sa attribution sharealike noncommercial noderivatives noderivs isc unlicense unencumbered public domain commons creative eclipse boost artistic zlib".split())
NEGATIONS = frozenset(b"not no never neither nor none cannot non isn aren wasn except".split())
ONWARD = frozenset(b"at by for in on to".split())
NEARBY = frozenset((b"copyright",))
REACH = 16  # words around a notice in which those nearby are looked for

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+(?:\.[0-9]+)*")


def words_of(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


def least_found(want: list[bytes]) -> int:
    return math.ceil(COVERED * len(want))


def signs_of(templates: list[list[bytes]]) -> set[bytes]:
    """Words of which every confirmed notice holds one: from each template one more than it may lack, the longest, sooner those that serve already."""
    out: set[bytes] = set()
    for want in templates:
        order = sorted(want, key=lambda w: (w in COMMON, w not in out, -len(w), w))
        out.update(order[:len(want) - least_found(want) + 1])
    return out


def telling(name: str, want: list[bytes]) -> set[int]:
    """Places of a wording's words that tell the licence: words of its name and of names in general, and numbers that follow those or "version"."""
    own = set(words_of(name.encode())) | NAMES
    return {k for k, w in enumerate(want) if w in own or w[:1].isdigit() and k and (want[k - 1] in own or want[k - 1] in (b"version", b"v", b"license"))}


def _local(want: list[bytes], have: list[bytes], price: float) -> list[tuple[int, int]]:
    """Pairs of places of the best local alignment: a word found counts 1, a word put in between costs `price`, one left out is free."""
    spots: dict[bytes, np.ndarray] = {w: np.flatnonzero([v == w for v in want]) for w in set(want)}
    score = np.zeros((len(have) + 1, len(want) + 1))
    for r, w in enumerate(have, 1):
        row = np.maximum(score[r - 1] - price, 0)
        at = spots.get(w)
        if at is not None:
            row[at + 1] = np.maximum(row[at + 1], score[r - 1][at] + 1)
        score[r] = np.maximum.accumulate(row)
    r, c = (int(x) for x in np.unravel_index(np.argmax(score), score.shape))
    out = []
    while score[r, c] > 0:
        if want[c - 1] == have[r - 1] and score[r, c] == score[r - 1, c - 1] + 1:
            out.append((c - 1, r - 1))
            r, c = r - 1, c - 1
        elif score[r, c] == score[r, c - 1]:
            c -= 1
        else:
            r -= 1
    return out[::-1]


def align(want: list[bytes], have: list[bytes]) -> list[tuple[int, int]] | None:
    """Pairs of places of the template's words found in order, or None where too few are or too many others lie between.

    Words are aligned locally at several prices of a word put in between, so a stray word far from the notice does not count; of those that hold, the
    alignment that differs least is taken.
    """
    best = None
    for price in PRICES:
        got = _local(want, have, price)
        if len(got) < least_found(want):
            break
        extra = got[-1][1] - got[0][1] + 1 - len(got)
        if extra <= len(want) and (best is None or extra - len(got) < best[0]):
            best = extra - len(got), got
    return best[1] if best else None


class Scanner:
    """Templates ready to be looked for, with compressors made once for a task."""

    def __init__(self, templates: dict[str, str | Sequence[str]]):
        flat = [(n, words_of(x.encode())) for n, t in templates.items() for x in ([t] if isinstance(t, str) else t)]
        self.names, self.words = [n for n, w in flat if w], [w for _, w in flat if w]
        self.signs = sorted(signs_of(self.words))
        self.vocabulary = frozenset(w for want in self.words for w in want)
        self.sets = [frozenset(w) for w in self.words]
        self.telling = [telling(n, w) for n, w in zip(self.names, self.words)]
        texts = [b" ".join(w) for w in self.words]
        self.plain = zstandard.ZstdCompressor(level=3)
        self.own = [len(self.plain.compress(t)) for t in texts]
        self.with_ = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(t + b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for t in texts]

    def saved(self, i: int, text: bytes, alone: int) -> int:
        """Bytes that template i saves as a dictionary of a text, whose compressed size without one is `alone`."""
        return alone - len(self.with_[i].compress(text))

    def gain(self, i: int, span: list[bytes]) -> float:
        """The bytes that a template saves as a dictionary of the span, over its own compressed size."""
        text = b" ".join(span)
        return self.saved(i, text, len(self.plain.compress(text))) / self.own[i]

    def ranked(self, which: Iterable[int], block: list[bytes]) -> list[int]:
        """Templates by what they save of the block less what of themselves goes unused, most first; ties go to the one listed first."""
        text = b" ".join(block)
        alone = len(self.plain.compress(text))
        return sorted(which, key=lambda i: (self.own[i] - 2 * self.saved(i, text, alone), i))

    def windows(self, have: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(template, from, to): ranges of words outside of which a template has no notice: one has enough of its words within twice its length."""
        spots: dict[bytes, list[int]] = {}
        for k, w in enumerate(have):
            if w in self.vocabulary:
                spots.setdefault(w, []).append(k)
        for i, want in enumerate(self.words):
            need = least_found(want)
            held = [spots[w] for w in self.sets[i] if w in spots]
            if sum(map(len, held)) < need:
                continue
            at = np.sort(np.concatenate(held))
            first, last = at[:len(at) - need + 1], at[need - 1:]
            near = last - first < 2 * len(want)
            first, last = first[near], last[near]
            if len(first):
                cuts = np.flatnonzero(first[1:] > last[:-1]) + 1
                for lo, hi in zip(first[np.r_[0, cuts]].tolist(), last[np.r_[cuts - 1, len(last) - 1]].tolist()):
                    yield i, lo, hi + 1

    def confirm(self, have: list[bytes], i: int, lo: int, hi: int) -> tuple | None:
        """(template, from, to, missing, extra) of a notice of template i in have[lo:hi], or None where its wording is another's.

        Too few words in order, or too many between them, are no notice. Nor is it one if a word that tells the licence (its name, version or
        number) is missing or another stands between, if a negation was put in or stands right before, or if only the surroundings could say
        what is meant and do not.
        """
        todo = [(lo, hi)]
        while todo:
            lo, hi = todo.pop()
            if hi - lo < least_found(self.words[i]):
                continue
            got = self.exactly(i, have[lo:hi]) or align(self.words[i], have[lo:hi])
            if got:
                notice = self.judged(have, i, lo, got)
                if notice:
                    return notice
                todo += [(lo + got[-1][1] + 1, hi), (lo, lo + got[0][1])]
        return None

    def exactly(self, i: int, have: list[bytes]) -> list[tuple[int, int]] | None:
        """Pairs of places where all words of template i stand in a row, at the first such place."""
        text = b" " + b" ".join(have) + b" "
        at = text.find(b" " + b" ".join(self.words[i]) + b" ")
        if at < 0:
            return None
        first = text.count(b" ", 0, at)
        return [(k, first + k) for k in range(len(self.words[i]))]

    def judged(self, have: list[bytes], i: int, lo: int, got: list[tuple[int, int]]) -> tuple | None:
        """The notice of template i at the places got, counted from lo, unless its words make it another's."""
        want = self.words[i]
        at, to = lo + got[0][1], lo + got[-1][1] + 1
        held, within = {k for k, _ in got}, {lo + k for _, k in got}
        missing = [k for k in range(len(want)) if k not in held]
        extra = [k for k in range(at, to) if k not in within]
        near = frozenset(have[max(0, at - REACH):at] + have[to:to + REACH])
        if any(k in self.telling[i] for k in missing) or any(w in NEGATIONS for w in have[max(0, at - 2):at]):
            return None
        for k in extra:
            if have[k] in NAMES or have[k] in NEGATIONS or have[k][:1].isdigit() and (have[k - 1] in NAMES or have[k - 1] in (b"version", b"v")):
                return None
        away = {want[k] for k in missing} & NEARBY - near
        if away and to < len(have) and have[to] in ONWARD:
            return None
        return i, at, to, [want[k] for k in missing], [have[k] for k in extra]

    def net(self, notice: tuple) -> int:
        """Words found less those that differ."""
        i, _, _, missing, extra = notice
        return len(self.words[i]) - 2 * len(missing) - len(extra)

    def notices(self, have: list[bytes]) -> list[tuple]:
        """(template, from, to, missing, extra) of every notice, in order; they do not overlap.

        Windows that overlap make a block, read in parts of a few longest wordings that overlap too. Templates with a window in a part are ranked by
        compression, the first that its wording confirms is taken (the wording of its licence that differs least there), and what lies before and
        after it is ranked again.
        """
        windows = sorted(self.windows(have), key=lambda w: w[1])
        out: list[tuple] = []
        ahead, open_ = 0, []
        todo: list[tuple[int, int, int]] = []  # from, to, longest wording
        for i, lo, hi in windows:
            if todo and lo < todo[-1][1]:
                todo[-1] = todo[-1][0], max(hi, todo[-1][1]), max(len(self.words[i]), todo[-1][2])
            else:
                todo.append((lo, hi, len(self.words[i])))
        todo.reverse()
        while todo:
            lo, hi, longest = todo.pop()
            end = min(hi, lo + BLOCK * longest)
            while ahead < len(windows) and windows[ahead][1] < end:
                open_.append(windows[ahead])
                ahead += 1
            open_ = [w for w in open_ if w[2] > lo]
            parts: dict[int, list[tuple[int, int]]] = {}
            for i, a, b in open_:
                a, b = max(a, lo), min(b, end)
                if b - a >= least_found(self.words[i]):
                    parts.setdefault(i, []).append((a, b))
            got = None
            for i in self.ranked(parts, have[lo:end]) if parts else ():
                if got is None or self.names[i] == self.names[got[0]] and len(self.words[i]) > self.net(got):
                    for new in filter(None, (self.confirm(have, i, a, b) for a, b in parts[i])):
                        if got is None or new[1] < got[2] and new[2] > got[1] and self.net(new) > self.net(got):
                            got = new
            if got is None:
                if end < hi:
                    todo.append((end - 2 * longest, hi, longest))
                continue
            _, at, to, _, _ = got
            if end < hi and at > lo and to > end - longest:  # it may go on beyond this part
                todo += [(at, hi, longest), (lo, at, longest)]
                continue
            out.append(got)
            todo += [(to, hi, longest), (lo, at, longest)]
        return sorted(out, key=lambda m: m[1])


def scan(docs: DataFrame, templates: dict[str, str | Sequence[str]] | None = None) -> DataFrame:
    """(doc_id, start, end, license, exact, gain, covered, missing, extra): a row for each notice confirmed in a document.

    docs needs doc_id and text; other columns are not looked at. templates gives each licence one wording or several. Notices are looked for in the
    words of the whole text, wherever lines break; start and end are byte positions in it, at blanks. missing are template words the notice lacks,
    extra are words between the template's; exact means none of either. gain is what the template saves as a compression dictionary. Notices
    do not overlap: templates are ranked by the bytes they save as a dictionary of the words around, and the first whose wording is confirmed is taken.
    A notice with another name, version or number, or with a negation, is not confirmed; nor are reserved rights that go on ("by", "to") far from "copyright".
    Null and blank texts give none. Ties between templates go to the one listed first. Repeated rows give repeated results; a null doc_id is kept.
    """
    given = templates or TEMPLATES
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(given)
        for b in text_batches(batches):
            rows, out = [], []
            for i, text in enumerate(raw(b, "text")):
                low = text.lower() if text else b""
                if not any(s in low for s in scanner.signs):
                    continue
                have = _WORD.findall(low)
                found = scanner.notices(have)
                spans = [m.span() for m in _WORD.finditer(low)] if found else []
                for t, at, to, missing, extra in found:
                    start, end = spans[at][0], spans[to - 1][1]
                    while start and not low[start - 1:start].isspace():
                        start -= 1
                    while end < len(low) and not low[end:end + 1].isspace():
                        end += 1
                    rows.append(i)
                    out.append((start, end, scanner.names[t], not missing and not extra, scanner.gain(t, have[at:to]), 1 - len(missing) / len(scanner.words[t]),
                                [w.decode(errors="replace") for w in missing], [w.decode(errors="replace") for w in extra]))
            cols = list(zip(*out)) or [[]] * 8
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.float64(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                                             ["doc_id", "start", "end", "license", "exact", "gain", "covered", "missing", "extra"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, start long, end long, license string, exact boolean, gain double, covered double, missing array<string>, extra array<string>")
