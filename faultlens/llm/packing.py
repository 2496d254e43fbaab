"""Best-fit packing of tokenised documents into sequences, searched by bin completion."""

from __future__ import annotations

import os
import re
import sys
import types
from collections import Counter
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import store
from faultlens.llm.substrings import text_batches
from faultlens.session import ship, with_ordinal

CAPACITY = 2048
END = 0
TOKENIZER = "byte_bpe_50k.json"
REMEMBERED = 64 << 20  # bytes that a task holds of pieces of text and their ids, about
ENTRY = 200  # bytes that a remembered piece takes besides its own
PIECES = 1 << 19  # pieces that are looked up at once
ROWS_BYTES = 1 << 26  # of ids that a batch of rows has at most
FILLINGS = 16  # fillings around a largest piece that are held at once
STEPS = 1_000_000  # sets of pieces walked in all before the incumbent is taken; a filling tried counts as TRIED of them
TRIED = 25

LETTER, DIGIT, OTHER, QUOTE, SPACE, BLANK, UNSURE, ODD, NOTHING = range(9)
# QUOTE may open 's or 'll. BLANK: tab to carriage return. UNSURE: not ASCII, no blank, and not known to be a letter. ODD: other blanks, or what some take for one.
_CLASS = np.full(256, UNSURE, np.uint8)
_CLASS[:128] = OTHER
for _chars, _class in ((b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", LETTER), (b"0123456789", DIGIT), (b"'", QUOTE), (b" ", SPACE), (range(9, 14), BLANK), (range(28, 32), ODD)):
    _CLASS[list(_chars)] = _class
_ODD = [c.encode() for c in map(chr, range(128, 0x3001)) if c.isspace() or c == "\u180e"]
_SOLID = np.isin(np.arange(9), (LETTER, DIGIT, OTHER, QUOTE, UNSURE))  # classes that are certainly no blank
_CUT = np.zeros((9, 9), bool)  # classes before and after a place where ByteLevel's pattern always cuts
_CUT[_SOLID, SPACE] = _CUT[_SOLID, BLANK] = True
for _a, _b in ((LETTER, DIGIT), (LETTER, OTHER), (LETTER, QUOTE), (DIGIT, LETTER), (DIGIT, OTHER), (DIGIT, QUOTE), (OTHER, LETTER), (OTHER, DIGIT)):
    _CUT[_a, _b] = True
_PLAIN = re.compile(r" ?[^\s\u180e]+")  # pieces that a line feed parts from their neighbours and leaves as they are


def _classes(data: np.ndarray) -> np.ndarray:
    """The class of each byte of UTF-8 texts; Latin-1 letters are letters, further ones are UNSURE."""
    got = _CLASS[data]
    if (got == UNSURE).any():
        at = np.flatnonzero(data[:-1] == 0xC3)
        at = at[(data[at + 1] != 0x97) & (data[at + 1] != 0xB7)]
        got[at] = got[at + 1] = LETTER
        leads = {c[0]: np.flatnonzero(data[:1 - len(c)] == c[0]) for c in _ODD}
        for c in _ODD:
            at = leads[c[0]]
            for k in range(1, len(c)):
                at = at[data[at + k] == c[k]]
            for k in range(len(c)):
                got[at + k] = ODD
    return got


def piece_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pieces of texts begin, ascending, in the bytes of texts one after another; starts: of texts that are not empty, ascending.

    Only places count where ByteLevel's pattern cuts whatever stands further off, and where a piece alone is cut as in its text: between two kinds of
    characters, before a run of blanks, before the last of a run that something follows, and after that one if it is no space.
    """
    here = _classes(data)
    before, after = np.empty_like(here), np.empty_like(here)
    before[1:], after[:-1] = here[:-1], here[1:]
    before[starts], after[np.r_[starts[1:], len(data)] - 1] = NOTHING, NOTHING
    cut = _CUT.ravel()[before * np.uint8(9) + here]
    last = np.flatnonzero((here == SPACE) | (here == BLANK))
    last = last[_SOLID[after[last]] & (before[last] != ODD)]
    cut[last] = True
    line = last[here[last] == BLANK]
    cut[line + 1] = True
    cut[starts] = True
    return np.flatnonzero(cut)


def gathered(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[first:first + size] of each pair, one after another."""
    ends = np.cumsum(size)
    return values[np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


class Tokens:
    """Token ids of whole texts. Texts are cut where the tokenizer always cuts, and the ids of a piece are remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers
        t = self.tokenizer = Tokenizer.from_file(path)
        kind = t.pre_tokenizer
        self.cuts = (isinstance(kind, pre_tokenizers.ByteLevel) and kind.use_regex and not kind.add_prefix_space
                     and t.normalizer is None and t.truncation is None and t.padding is None)
        self.special = [x.content for x in t.get_added_tokens_decoder().values()]
        first = t.encode(" ", add_special_tokens=False).tokens
        self.opens, self.lines = np.zeros((2, t.get_vocab_size()), bool)  # ids that begin with a space, and that of a line feed
        self.opens[[i for x, i in t.get_vocab().items() if first and x.startswith(first[0])]] = True
        self.lines[t.encode("\n", add_special_tokens=False).ids] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}  # piece -> its number
        self.ids, self.ends, self.held = np.zeros(0, "<u4"), np.zeros(1, np.int64), 0  # ids of all pieces, and where those of each number end

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded(self, pieces: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """In which order pieces were encoded, all their ids in that order, and how many each has.

        Plain ones go through the tokenizer in runs, where its ids tell a space at the front, or a line feed put between, from the rest.
        """
        texts = [p.decode() for p in pieces]
        spaced, bare, rest = [], [], []
        for i, t in enumerate(texts):
            (rest if not self.cuts or not _PLAIN.fullmatch(t) else spaced if t[0] == " " else bare).append(i)
        order, ids, sizes = [], [], []
        for run, between, marks in ((spaced, "", self.opens), (bare, "\n", self.lines)):
            for at in range(0, len(run), 1024):
                part = run[at:at + 1024]
                got = np.array(self.tokenizer.encode_batch_fast([between.join([texts[i] for i in part])], add_special_tokens=False)[0].ids, "<u4")
                begins = np.flatnonzero(marks[got])
                if between:
                    got, begins = got[~marks[got]], np.r_[0, begins - np.arange(len(begins))]
                if len(begins) == len(part) and not begins[0]:
                    order += part
                    ids.append(got)
                    sizes.append(np.diff(begins, append=len(got)))
                else:
                    rest += part
        if rest:
            data = self.whole([texts[i] for i in rest])
            ids.append(np.frombuffer(b"".join(data), "<u4"))
            sizes.append(np.array([len(x) // 4 for x in data]))
        return order + rest, np.concatenate(ids), np.concatenate(sizes)

    def _numbers(self, pieces: list[bytes]) -> np.ndarray:
        """The numbers of different pieces; new ones are learned. When too much is held, what is not among them is forgotten."""
        got = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        if self.held > REMEMBERED:
            seen = np.flatnonzero(got >= 0)
            first, size = self.ends[got[seen]], np.diff(self.ends)[got[seen]]
            self.ids, self.ends = gathered(self.ids, first, size), np.r_[0, np.cumsum(size)]
            self.known = {pieces[i]: k for k, i in enumerate(seen.tolist())}
            self.held = 4 * len(self.ids) + sum(map(len, self.known)) + ENTRY * len(self.known)
            got[seen] = np.arange(len(seen))
        lost = np.flatnonzero(got < 0)
        if len(lost):
            new = [pieces[i] for i in lost.tolist()]
            order, ids, size = self._encoded(new)
            got[lost[order]] = np.arange(len(self.known), len(self.known) + len(new))
            self.known.update(zip(new, got[lost].tolist()))
            self.ends = np.r_[self.ends, self.ends[-1] + np.cumsum(size)]
            self.ids = np.r_[self.ids, ids]
            self.held += ids.nbytes + sum(map(len, new)) + ENTRY * len(new)
        return got

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's end; a null has none."""
        texts = pc.fill_null(texts.cast(pa.binary()), b"")
        _, places, held = texts.buffers()
        at = np.frombuffer(places, np.int32)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
        data = np.frombuffer(held, np.uint8)[at[0]:at[-1]] if held is not None else np.zeros(0, np.uint8)
        at = at.astype(np.int64) - at[0]
        full = np.flatnonzero(np.diff(at))
        if not len(full):
            return np.zeros(0, "<u4"), np.zeros(len(texts), np.int64)
        starts = at[full]
        begins = piece_starts(data, starts) if self.cuts else starts
        special = np.zeros(len(texts), bool)
        for s in self.special:
            special |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        if special.any():  # uncut
            of = np.searchsorted(starts, begins, "right") - 1
            begins = begins[~special[full[of]] | (begins == starts[of])]
        ends = np.r_[begins[1:], len(data)]
        ids, size = [], np.empty(len(begins), np.int64)
        for a in range(0, len(begins), PIECES):
            b = min(a + PIECES, len(begins))
            edges = np.r_[begins[a:b], ends[b - 1]].astype(np.int32)
            coded = pa.BinaryArray.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(edges), pa.py_buffer(data)]).dictionary_encode()
            number = self._numbers(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
            size[a:b] = np.diff(self.ends)[number]
            ids.append(gathered(self.ids, self.ends[number], size[a:b]))
        total = np.r_[0, np.cumsum(size)]
        return np.concatenate(ids), total[np.searchsorted(begins, at[1:])]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        ids, ends = self.flat(pa.array(texts, pa.string()))
        data, ends = ids.tobytes(), (4 * ends).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]


def _tokens(path: str) -> Tokens:
    """One tokenizer for a worker process, kept between tasks, without the pieces that earlier tasks remembered."""
    kept = sys.modules.setdefault("_kept_tokenizers", types.ModuleType("_kept_tokenizers"))
    if not hasattr(kept, path):
        setattr(kept, path, Tokens(path))
    tokens = getattr(kept, path)
    tokens.forget()
    return tokens


def tokenised(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids): each whole text as token ids and an end id, in pieces of at most `capacity`.

    Only a longer document is cut; then all pieces but the first are full. ids is binary: little-endian unsigned 32-bit. Null texts count as
    empty: one piece that is the end id alone. tokenizer is the path of a tokenizers file, the same on every worker.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(path)
        for b in text_batches(batches):
            ids, ends = tokens.flat(b.column("text"))
            ids = np.insert(ids, ends, END)
            ends = ends + np.arange(1, len(ends) + 1)
            n = np.diff(ends, prepend=0)
            many = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), many)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            start = np.maximum(0, n[row] - (many[row] - piece) * capacity)
            length = n[row] - (many[row] - 1 - piece) * capacity - start
            places = np.r_[0, np.cumsum(length)]
            step = max(1, ROWS_BYTES // (4 * capacity))
            for a in range(0, len(row), step):
                rows = slice(a, a + step)
                at = places[a:a + step + 1]
                held = [None, pa.py_buffer((4 * (at - at[0])).astype(np.int32)), pa.py_buffer(ids[at[0]:at[-1]])]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pa.array(row[rows])), pa.array(piece[rows], pa.int32()), pa.array(start[rows]), pa.array(length[rows]),
                     pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, held)],
                    ["doc_id", "piece", "start", "length", "ids"])
        tokens.forget()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids binary")


Filling = tuple[tuple[int, int], ...]  # (length, how many), longest first


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing on counts of lengths: (filling, how many sequences hold it)."""
    open_: dict[int, list[tuple[Filling, int]]] = {}  # room left -> sequences
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            room = min((r for r in open_ if r >= size), default=None)
            filling, n = open_[room].pop() if room is not None else ((), left)
            if room is not None and not open_[room]:
                del open_[room]
            room = capacity if room is None else room
            fit = room // size
            full = min(n, left // fit)
            for many, each in ((full, fit), (int(full < n and left % fit > 0 and left < n * fit), left - full * fit)):
                if many:
                    open_.setdefault(room - each * size, []).append((filling + ((size, each),), many))
                    left -= many * each
                    n -= many
            if n and filling:
                open_.setdefault(room, []).append((filling, n))
    return [x for group in open_.values() for x in group]


def least_sequences(counts: np.ndarray, capacity: int) -> int:
    """A lower bound on the sequences that counts of lengths take: volume, and for each K, pieces over `capacity` - K get no company of K or more."""
    sizes = np.arange(capacity + 1)
    many, volume = np.cumsum(counts), np.cumsum(counts * sizes)
    half = capacity // 2
    k = np.arange(1, half + 1)
    alone = many[capacity] - many[half]  # pieces over half a sequence each need their own
    room = (many[capacity - k] - many[half]) * capacity - (volume[capacity - k] - volume[half])
    small = volume[half] - volume[k - 1]
    more = np.maximum(0, small - room)
    return int(max(-(-volume[capacity] // capacity), alone + (-(-more // capacity)).max(initial=0)))


def _dominated(filling: Filling, counts: np.ndarray, open_: int, room: int) -> bool:
    """Whether a piece left out could take the place of a part of the filling that is no longer, so that the filling need not be tried.

    The piece must fit in the waste besides, and be longer than the part or stand for several pieces. open_ has a bit for each length there is. Sums of
    parts are bits of one integer too, so a filling of many pieces costs no more than a shift for each.
    """
    one, more, used = 0, 0, 0
    for size, n in filling:
        if n == counts[size]:
            open_ &= ~(1 << size)
        used += n * size
        for _ in range(n):
            more |= (more | one) << size
            one |= 1 << size
    waste = room - used
    over, reach = (1 | one | more) << 1, 1  # sums, smeared over 1 to `waste` more
    if not waste:
        return bool(more & open_)
    while reach < waste:
        step = min(reach, waste - reach)
        over |= over << step
        reach += step
    return bool((over | more) & open_ & ((1 << room + 1) - 1))


def fillings(counts: np.ndarray, room: int, budget: list[int] | None = None) -> Iterator[Filling]:
    """Every undominated filling of `room` from counts of lengths, least waste first; a single piece that fills it all comes alone.

    For each waste in turn, the sets of pieces that leave exactly it are walked, longest pieces and most copies first and fewer copies after. Bits of the
    sums that the shorter lengths can still make keep the walk out of dead ends, and give the last pieces exactly. budget[0], if given, counts down with
    each set walked, dominated or not, and ends the walk at 0.
    """
    if room <= 0 or not counts[1:room + 1].any():
        yield ()
        return
    if counts[room]:
        yield ((room, 1),)
        return
    sizes = np.flatnonzero(counts[:room + 1]).tolist()  # ascending
    most = [min(int(counts[s]), room // s) for s in sizes]
    mask = (1 << room + 1) - 1
    sums = [1]  # sums[k]: what the k shortest lengths can make
    for s, n in zip(sizes, most):
        got, left, step = sums[-1], n, 1
        while left:
            step = min(step, left)
            got |= got << step * s & mask
            left -= step
            step *= 2
        sums.append(got)
    open_ = sum(1 << s for s in sizes)

    def walk(k: int, want: int) -> Iterator[Filling]:
        if not want:
            yield ()
        while want and sums[k] >> want & 1:
            k -= 1
            for n in range(min(most[k], want // sizes[k]), 0, -1):
                if sums[k] >> want - n * sizes[k] & 1:
                    for rest in walk(k, want - n * sizes[k]):
                        yield ((sizes[k], n),) + rest

    for waste in range(room + 1):
        if sums[-1] >> room - waste & 1:
            for f in walk(len(sizes), room - waste):
                if budget is not None:
                    budget[0] -= 1
                    if budget[0] < 0:
                        return
                if not _dominated(f, counts, open_, room):
                    yield f


def complete(counts: dict[int, int], capacity: int, steps: int = STEPS) -> list[tuple[Filling, int]]:
    """Fillings and their numbers for all pieces, in as few sequences as the search finds.

    Depth-first bin completion: around the largest piece left, undominated fillings are tried least waste first, each as often as the pieces allow and
    then once; a branch is cut when its waste so far, or the bound of what is left, leaves no better total than the incumbent, or when its pieces were left
    before. The best-fit solution is the first incumbent. The search ends at the lower bound, when all is tried, or after `steps` sets walked. Lengths
    are at most `capacity`, so neither counts nor time grow with the number of pieces.
    """
    best = best_fit(counts, capacity)
    total = sum(s * n for s, n in counts.items())
    left = np.zeros(capacity + 1, np.int64)
    for s, n in counts.items():
        left[s] = n
    least = least_sequences(left, capacity)
    have = sum(n for _, n in best)
    if have <= least:
        return best

    def around(top: int, seen: int) -> Iterator[tuple[Filling, int]]:
        """The next fillings of a largest piece; the pieces left are the same whenever its level asks, so what was seen is passed over."""
        left[top] -= 1
        got = [tuple(sorted((Counter({top: 1}) + Counter(dict(f))).items(), reverse=True)) for f in islice(fillings(left, capacity - top, budget), seen, seen + FILLINGS)]
        left[top] += 1
        for f in got:
            n = int(min(left[s] // k for s, k in f))
            yield f, n
            if n > 1:
                yield f, 1

    path: list[tuple[Filling, int]] = []
    levels: list[list] = []  # largest piece, fillings fetched, those of them not tried
    known: set[int] = set()
    waste, used, down, budget = 0, 0, True, [steps]
    while budget[0] > 0:
        if down:
            if not left.any():
                best, have = list(path), used
                if have <= least:
                    break
            else:
                levels.append([int(np.flatnonzero(left)[-1]), 0, []])
        if len(path) == len(levels):  # all packed, or nothing of the level left to try
            if not path:
                break
            f, n = path.pop()
            for s, k in f:
                left[s] += k * n
            used -= n
            waste -= n * (capacity - sum(s * k for s, k in f))
        level = levels[-1]
        if not level[2]:
            level[2] = list(around(level[0], level[1]))[::-1]
            level[1] += FILLINGS
        if not level[2]:
            levels.pop()
            down = False
            if not levels:
                break
            continue
        f, n = level[2].pop()
        budget[0] -= TRIED
        more = n * (capacity - sum(s * k for s, k in f))
        down = False
        if -(-(total + waste + more) // capacity) >= have:  # waste bound: the fillings after it waste no less
            if n == 1:
                levels.pop()
                if not levels:
                    break
            continue
        for s, k in f:
            left[s] -= k * n
        key = hash((used + n, left.tobytes()))
        if key in known or used + n + least_sequences(left, capacity) >= have:
            for s, k in f:
                left[s] += k * n
            continue
        known.add(key)
        waste, used, down = waste + more, used + n, True
        path.append((f, n))
    return best


def layout(solution: list[tuple[Filling, int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, how many in a sequence, offset), sorted: where the pieces of a length go by their rank."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for filling, n in solution:
        at = 0
        for size, k in filling:
            rank = taken.get(size, 0)
            rows.append((size, rank, sequence, k, at))
            taken[size] = rank + n * k
            at += size * k
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset added: each row is placed whole, gapless from 0, in a sequence of at most `capacity`.

    pieces has doc_id, piece, length and any other columns; lengths are from 1 to `capacity`. The search sees only how many pieces have each length
    (`capacity` counts, the one thing the driver gets); a piece then finds its place by its rank among those of its length, so a length that a
    third of all pieces have is spread like any other. Ties between equal pieces are broken by doc_id and piece. No pieces give no rows.
    """
    counts = dict(pieces.groupBy("length").count().collect())
    rows = layout(complete(counts, capacity))
    ahead = np.cumsum([0] + [counts.get(s, 0) for s in range(capacity + 1)])
    key = rows[:, 0] << 40 | rows[:, 1]
    placed = with_ordinal(pieces, ["length", "doc_id", "piece"], "_rank")
    names = placed.columns
    ship(pieces.sparkSession)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column("length").to_numpy()
            rank = b.column("_rank").to_numpy() - 1 - ahead[size]
            at = np.searchsorted(key, size << 40 | rank, "right") - 1
            _, first, sequence, each, offset = rows[at].T
            nth, inside = np.divmod(rank - first, each)
            kept = [b.column(n) for n in names if n != "_rank"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence + nth), pa.array(offset + inside * size)],
                                             [*(n for n in names if n != "_rank"), "sequence_id", "offset"])

    schema = placed.drop("_rank").schema.add("sequence_id", "long").add("offset", "long")
    return placed.mapInArrow(put, schema)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, ids: bool = True) -> DataFrame:
    """Documents as packed pieces: (doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset); ids=False leaves the ids out.

    docs needs doc_id and text; other columns are not looked at. Repeated rows are packed as often as they occur; a null doc_id is kept.
    """
    got = tokenised(docs, tokenizer, capacity).withColumn("ids_crc32", F.crc32("ids"))
    return pack(store(got if ids else got.drop("ids"), "pieces"), capacity)
