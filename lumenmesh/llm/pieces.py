"""SentencePiece encoding and decoding by a streaming Viterbi search.

For every end position the search keeps a backpointer to where its last piece starts, within a window of the longest
piece; whenever the paths of all positions that a later piece could start from meet in one boundary, the ids up to it are
committed and forgotten, so memory doesn't grow with the text.

Unigram models maximise the sum of scores. BPE models have no sums to maximise: there a path survives if each two
neighbouring pieces are what merging their joined characters by rank gives; exactly one such path ends at each position,
and it is the merge result, so the ids equal the library's. Characters outside the vocabulary become byte pieces.

Every text runs whole through one `Stream`. Pieces never reach across a word start (checked on loading), so there all paths
have met: the stream commits, and what it found for a stretch between two such boundaries is remembered for the next time.
Under a BPE model the new stretches of a chunk of texts are searched together, end position by end position; those beyond
2 * longest characters go through `Stream` alone.

Defined cases: null and empty texts have no ids; U+2581 counts as a space, as in the library, so it decodes to one; control
strings such as ``<s>`` in a text are ordinary characters; repeated rows are encoded alike; a null doc_id is kept; other
columns pass by in `encode`.
"""

from __future__ import annotations

import math
import re
from array import array
from functools import lru_cache
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MODELS, chunks, sliced, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: What a Python worker remembers: bytes of words of one generation of two, pairs of pieces, characters that no piece is.
#: These bound memory, not what is encoded.
REMEMBERED, FITS, STRANGE = 14 << 20, 100_000, 10_000
#: Characters that a stream is fed at a time.
BLOCK = 1 << 16
#: Characters of the texts whose new stretches are searched together.
AT_ONCE = 1 << 20
UNKNOWN_PENALTY = 10.0
#: Two places in one number; the place that stands for the start of a text.
SHIFT = 32
START = (1 << 31) - 1
#: Stretches that are searched at a time; bits of a character.
TOGETHER = 1 << 13
CHAR = 21
#: Of the pairs of pieces that were asked for, so many (a power of two) can be looked up together; a factor that spreads them.
SLOTS, SPREAD = 19, np.uint64(0x9E3779B97F4A7C15)


def code_points(words: list[str], lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted strings as rows of code points (0 beyond their ends), and how many each shares with the one before."""
    longest = max(int(lens.max()), 1)
    grid = np.array(words, f"U{longest}").view(np.uint32).reshape(len(words), longest)
    same = np.zeros(len(words), np.int64)
    differ = grid[1:] != grid[:-1]
    same[1:] = np.where(differ.any(1), differ.argmax(1), longest)
    np.minimum(same[1:], np.minimum(lens[1:], lens[:-1]), out=same[1:])
    return grid, same


class Suffixes:
    """The longest piece that ends at a place, and from a piece the next shorter one that ends there too.

    A state stands for the longest beginning of a piece that ends at a place (0: none); `falls` leads to the next shorter one."""

    def __init__(self, ids: dict[str, int]) -> None:
        words = sorted(filter(None, ids))
        lens = np.fromiter(map(len, words), np.int64, len(words))
        self.longest, self.shorter, self.length = np.full(1, -1, np.int32), {}, {}
        self.keys = self.to = np.zeros(0, np.int64)
        if not words:
            self.falls = np.zeros(1, np.int64)
            return
        grid, same = code_points(words, lens)
        # states are the distinct beginnings, numbered by length
        depths = np.arange(1, grid.shape[1] + 1)
        new = (depths > same[:, None]) & (depths <= lens[:, None])
        state, count, rows = np.zeros(len(words), np.int64), 1, []
        keys, to, whole = [], [], np.zeros(len(words), np.int64)
        for d in depths:
            r = np.flatnonzero(new[:, d - 1])
            keys.append(state[r] << CHAR | grid[r, d - 1])
            to.append(count + np.arange(len(r)))
            state = count + np.maximum(np.cumsum(new[:, d - 1]) - 1, 0)
            whole[lens == d] = state[lens == d]
            count += len(r)
            rows.append((keys[-1], to[-1]))
        keys, to = np.concatenate(keys), np.concatenate(to)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], to[order]
        self.falls, self.longest = np.zeros(count, np.int64), np.full(count, -1, np.int32)
        place = np.fromiter((ids[w] for w in words), np.int32, len(words))
        self.longest[whole] = place
        self.shorter, self.length = np.full(place.max() + 1, -1, np.int32), np.zeros(place.max() + 1, np.int64)
        self.length[place] = lens
        for k, s in rows:
            before = k >> CHAR
            below = np.where(before > 0, self.step(self.falls[before], k & (1 << CHAR) - 1), 0)
            self.falls[s] = below
            own = self.longest[s]
            self.shorter[own[own >= 0]] = self.longest[below[own >= 0]]
            self.longest[s] = np.where(own >= 0, own, self.longest[below])

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The states after one more character each."""
        out, todo = np.zeros(len(state), np.int64), np.arange(len(state))
        while len(todo) and len(self.keys):
            key = state << CHAR | char
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            hit = self.keys[at] == key
            out[todo[hit]] = self.to[at[hit]]
            rest = ~hit & (state > 0)
            todo, state, char = todo[rest], self.falls[state[rest]], char[rest]
        return out


class Fits(dict):
    """Which two places may follow each other on a BPE path, found out when asked for."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.find, self.slots = model.allowed, np.full(1 << SLOTS, ~np.uint64(0))

    def __missing__(self, key: int) -> bool:
        return self.find(key)

    def all(self, keys: np.ndarray) -> np.ndarray:
        """The same for many at once; a slot holds the last key that came to it and, in the lowest bit, the answer."""
        keys = keys.astype(np.uint64)
        slot = (keys * SPREAD >> np.uint64(64 - SLOTS)).astype(np.int64)
        held, keys = self.slots[slot], keys << np.uint64(1)
        out = held != keys
        miss = np.flatnonzero(out & (held != keys | np.uint64(1)))
        if len(miss):
            keys = keys[miss]
            found = np.fromiter(map(self.__getitem__, (keys >> np.uint64(1)).tolist()), bool, len(miss))
            out[miss] = found
            self.slots[slot[miss]] = keys | found
        return out


class Model:
    """Pieces, scores and kind of a SentencePiece file."""

    def __init__(self, data: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(data)
        kind, norm = proto.trainer_spec.model_type, proto.normalizer_spec
        if kind not in (1, 2):
            raise ValueError("only unigram and BPE models are read")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only models without text normalisation are read")
        self.bpe, self.prefix = kind == 2, norm.add_dummy_prefix
        self.pieces = [(p.piece, p.score, p.type) for p in proto.pieces]
        self.byte_id = {int(t[3:5], 16): i for i, (t, _, kind) in enumerate(self.pieces) if kind == 6}
        self.unknown = next((i for i, p in enumerate(self.pieces) if p[2] == 2), 0)
        usable = {t: (i, s) for i, (t, s, kind) in enumerate(self.pieces) if kind in (1, 4)}
        self.score = {t: s for t, (_, s) in usable.items()}
        self.ids = {t: i for t, (i, _) in usable.items()}
        self.longest = max([1, *map(len, usable)])
        self.lowest = min([0.0, *self.score.values()]) - UNKNOWN_PENALTY
        # by the last one, two and three characters: lengths of the pieces that end so, the longest first
        tails: tuple[dict, ...] = ({}, {}, {})
        for t in usable:
            tails[min(len(t), 3) - 1].setdefault(t[-3:], set()).add(len(t))
        for shorter, longer in ((tails[0], tails[1]), (tails[1], tails[2])):
            for k, v in longer.items():
                v |= shorter.get(k[1:], tails[0].get(k[-1:], set()))
        self.ends1, self.ends2, self.ends3 = ({k: tuple(sorted(v, reverse=True)) for k, v in d.items()} for d in tails)
        #: Place -> string; beyond the pieces come characters that no piece is, as they turn up.
        self.names = [p[0] for p in self.pieces]
        self.strange: dict[str, int] = {}
        self.fits = Fits(self)
        self.grown: dict[int, tuple | None] = {}
        self.suffixes = Suffixes(self.ids) if self.bpe else None
        across = any(MARK in t.lstrip(MARK) for t in usable)
        used = set("".join(usable))
        alone = "".join(c for c in "\n\r\t" if c not in used)
        if across:
            self.splitter = None
        elif alone:
            self.splitter = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+|[{alone}]")
        else:
            self.splitter = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        raw = [self._raw(i) for i in range(len(self.pieces))]
        self.raw_len = np.array([len(x) for x in raw])
        self.raw_at = np.concatenate([[0], np.cumsum(self.raw_len)[:-1]])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.seen: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = self.widest = 0
        #: What a stretch ends before.
        self.stops = MARK + alone

    def split(self, text: str) -> list[str]:
        """The stretches of a whole text."""
        return self.splitter.findall((MARK if self.prefix else "") + text.replace(" ", MARK))

    def remember(self, words: list[str], ids: list[bytes]) -> None:
        self.held += 150 * len(words) + 2 * sum(map(len, words)) + sum(map(len, ids))
        self.seen.update(zip(words, ids))

    def forget(self) -> None:
        """Keeps what is remembered within bounds: words not seen again for a generation go."""
        if self.held > REMEMBERED:
            self.seen, self.older, self.held = {}, self.seen, 0
        if len(self.fits) > FITS:
            self.fits.clear()
        if len(self.strange) > STRANGE:
            del self.names[len(self.pieces) :]
            self.strange, self.fits, self.grown = {}, Fits(self), {}

    def _raw(self, i: int) -> bytes:
        text, _, kind = self.pieces[i]
        if kind == 6:
            return bytes([int(text[3:5], 16)])
        return b"" if kind == 3 else (" ⁇ " if kind == 2 else text.replace(MARK, " ")).encode()

    def ends(self, place: int) -> tuple | None:
        """How the first and the last part of a piece grow while merging by rank makes it from its characters (the best-scored
        neighbouring pair first, the leftmost of equals): for either end (part, the least score until it grows) in turn. None if
        merging doesn't make the piece."""
        if place in self.grown:
            return self.grown[place]
        score, parts = self.score, list(self.names[place])
        first, last, left, right = parts[0], parts[-1], [], []
        low_left = low_right = math.inf
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                self.grown[place] = None
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            low_left, low_right = min(low_left, best), min(low_right, best)
            if at == 0:
                left.append((first, low_left))
                first, low_left = parts[0], math.inf
            if at == len(parts) - 1:
                right.append((last, low_right))
                last, low_right = parts[-1], math.inf
        found = self.grown[place] = (*left, (first, -math.inf)), (*right, (last, -math.inf))
        return found

    def allowed(self, key: int) -> bool:
        """May a BPE path go on from one place to another? key: the first (START for none), shifted, and the second.

        It may if merging the joined characters makes both: as the two grow, each by its own merges in order of score, no pair
        across their border is ever the best one."""
        self.fits[key] = False
        before, after = key >> SHIFT, self.ends(key & (1 << SHIFT) - 1)
        if after is None:
            return False
        if before != START:
            there = self.ends(before)
            if there is None:
                return False
            (_, a), (b, _), score = there, after, self.score.get
            i = j = 0
            while True:
                (x, to_left), (y, to_right) = a[i], b[j]
                s = score(x + y)
                if s is not None and s > to_left and s >= to_right:
                    return False
                if to_left >= to_right:
                    if to_left == -math.inf:
                        break
                    i += 1
                else:
                    j += 1
        self.fits[key] = True
        return True

    def lengths(self, text: str, end: int) -> tuple[int, ...]:
        """Lengths of the pieces that may end there."""
        return (
            (self.ends3.get(text[end - 3 : end]) if end > 2 else None) or (self.ends2.get(text[end - 2 : end]) if end > 1 else None) or self.ends1.get(text[end - 1], ())
        )

    def place(self, c: str) -> int:
        """The place of a character that no piece is."""
        known = self.strange.get(c)
        if known is None:
            known = self.strange[c] = len(self.names)
            self.names.append(c)
        return known

    def emit(self, place: int) -> list[int]:
        if place < len(self.pieces):
            return [place]
        return [self.byte_id.get(b, self.unknown) for b in self.names[place].encode()] if self.byte_id else [self.unknown]


class Stream:
    """One streaming search over a whole text: feed characters, take committed ids, finish.

    Held are only the characters after the last committed boundary: position i of them has the start `back[i]` and the place
    `last[i]` of the piece that ends there. A boundary is committed as soon as the paths of all positions from which a later
    piece could start meet in it. Where a word starts that is known beforehand, as no piece reaches across (checked on
    loading): the only position left is the start itself. The search from one such boundary to the next depends on the
    characters between alone, so what it gave for a stretch is remembered and taken again. Inside of a stretch beyond
    2 * longest characters the backpointers of the last `longest` positions are followed to where they meet.

    `widest` is the most characters this search held uncommitted, `commits` the number of boundaries it committed."""

    def __init__(self, model: Model) -> None:
        self.m, self.ahead, self.marks, self.widest, self.commits = model, "", False, 0, 0
        self._fresh()

    def _fresh(self) -> None:
        self.text, self.back, self.last, self.best = "", [0], [START], [0.0]

    def feed(self, text: str) -> list[bytes]:
        """The ids (packed as 32-bit integers) that are sure after these characters."""
        m = self.m
        if m.splitter is None:
            return [self.search(text)]
        out: list[bytes] = []
        if self.text:  # within a long stretch: up to its end, which marks at its beginning are not
            n = len(text) - len(text.lstrip(MARK)) if self.marks else 0
            self.marks = self.marks and n == len(text)
            n = min((i for i in (text.find(c, n) for c in m.stops) if i >= 0), default=len(text))
            out.append(self.search(text[:n]))
            if n == len(text):
                return out
            out.append(self.close())
            text = text[n:]
        words = m.splitter.findall(self.ahead + text)
        self.ahead = words.pop() if words else ""
        out += self.take(words)
        if len(self.ahead) > 2 * m.longest:
            self.ahead, text = "", self.ahead
            self.marks = not text.strip(MARK)
            out.append(self.search(text))
        return out

    def finish(self) -> list[bytes]:
        if self.text:
            return [self.close()]
        words = self.m.splitter.findall(self.ahead) if self.m.splitter else []
        self.ahead = ""
        return self.take(words)

    def take(self, words: list[str]) -> list[bytes]:
        """Commits whole stretches."""
        self.commits += len(words)
        try:
            return list(map(self.m.seen.__getitem__, words))
        except KeyError:
            learn(self.m, set(words))
            return list(map(self.m.seen.__getitem__, words))

    def go_on(self, word: str, before: str) -> bytes:
        """The ids of a stretch, searched from what it shares with the one before."""
        n = len(commonprefix((word, before)))
        self.text = word[:n]
        del self.back[n + 1 :], self.last[n + 1 :], self.best[n + 1 :]
        self._advance(word[n:])
        return self._path(len(word))

    def search(self, text: str) -> bytes:
        """Searches on through a stretch; the ids up to where all paths meet."""
        out, step = b"", 2 * self.m.longest
        for i in range(0, len(text), step):
            self._advance(text[i : i + step])
            if len(self.text) > step:
                out += self._commit()
        return out

    def close(self) -> bytes:
        """The rest of a stretch: its end is the one position left."""
        return self._committed(len(self.text))

    def _advance(self, more: str) -> None:
        (self._merge if self.m.bpe else self._maximise)(more)
        if len(self.text) > self.widest:
            self.widest = len(self.text)

    def _merge(self, more: str) -> None:
        m, back, last = self.m, self.back, self.last
        ends3, ends2, ends1, ids, fits, allowed = m.ends3.get, m.ends2.get, m.ends1, m.ids.get, m.fits.get, m.allowed
        start = len(self.text)
        self.text = text = self.text + more
        for end in range(start + 1, len(text) + 1):
            for n in (end > 2 and ends3(text[end - 3 : end])) or (end > 1 and ends2(text[end - 2 : end])) or ends1.get(text[end - 1], ()):
                at = end - n
                if at >= 0 and (place := ids(text[at:end])) is not None:
                    key = last[at] << SHIFT | place
                    ok = fits(key)
                    if ok is None:
                        ok = allowed(key)
                    if ok:
                        back.append(at)
                        last.append(place)
                        break
            else:
                back.append(end - 1)
                place = ids(text[end - 1])
                last.append(m.place(text[end - 1]) if place is None else place)

    def _maximise(self, more: str) -> None:
        m, back, last, best = self.m, self.back, self.last, self.best
        start = len(self.text)
        self.text = text = self.text + more
        for end in range(start + 1, len(text) + 1):
            top, frm, which = best[end - 1] + m.lowest, end - 1, None
            for n in m.lengths(text, end):
                place = m.ids.get(text[end - n : end]) if n <= end else None
                if place is not None and (total := best[end - n] + m.pieces[place][1]) > top:
                    top, frm, which = total, end - n, place
            back.append(frm)
            last.append(m.place(text[end - 1]) if which is None else which)
            best.append(top)

    def _path(self, end: int) -> bytes:
        places = []
        while end:
            places.append(self.last[end])
            end = self.back[end]
        places.reverse()
        few = len(self.m.pieces)
        if places and max(places) >= few:
            places = [i for p in places for i in ((p,) if p < few else self.m.emit(p))]
        return array("i", places).tobytes()

    def _commit(self) -> bytes:
        """Ids up to the last boundary that all paths a later piece can follow have in common."""
        alive = set(range(max(0, len(self.text) - self.m.longest + 1), len(self.text) + 1))
        while len(alive) > 1:
            top = max(alive)
            alive.discard(top)
            alive.add(self.back[top])
        return self._committed(alive.pop())

    def _committed(self, cut: int) -> bytes:
        """Ids up to a boundary; what is before it is forgotten."""
        if not cut:
            return b""
        out = self._path(cut)
        self.commits += 1
        if cut == len(self.text):
            self._fresh()
            return out
        self.text, self.back, self.last = self.text[cut:], [max(0, b - cut) for b in self.back[cut:]], self.last[cut:]
        if not self.m.bpe:
            self.best = [s - self.best[cut] for s in self.best[cut:]]
        return out


def merge_all(m: Model, words: list[str]) -> list[bytes]:
    """The ids of sorted stretches under a BPE model: the search of `Stream._merge` over all of them at once, end position by
    end position. What a stretch shares with the one before is searched once: `own` are the positions that are its own."""
    count = len(words)
    lens = np.fromiter(map(len, words), np.int64, count)
    grid, same = code_points(words, lens)
    deepest, tails = grid.shape[1], m.suffixes
    # by end position and stretch: the place of the piece that ends there, and its length
    last, size = np.full((deepest + 1, count), START, np.int32), np.zeros((deepest + 1, count), np.int32)
    state = np.zeros(count, np.int64)
    alone = {c: m.place(c) if (i := m.ids.get(c)) is None else i for c in set().union(*words)}
    chars = np.array(sorted(map(ord, alone)), np.int64)
    single = np.array([alone[chr(c)] for c in chars], np.int32)
    for end in range(1, deepest + 1):
        mine = (same < end) & (lens >= end)
        own = np.flatnonzero(mine)
        char = grid[own, end - 1].astype(np.int64)
        now = tails.step(state[own], char)
        place, length = single[np.searchsorted(chars, char)], np.ones(len(own), np.int32)
        left, piece = np.arange(len(own)), tails.longest[now]
        while True:
            some = piece >= 0
            left, piece = left[some], piece[some]
            if not len(left):
                break
            n = tails.length[piece]
            key = last[end - n, own[left]].astype(np.int64) << SHIFT | piece
            ok = m.fits.all(key)
            place[left[ok]], length[left[ok]] = piece[ok], n[ok]
            left, piece = left[~ok], tails.shorter[piece[~ok]]
        # those that share this position have it from the last one before them whose own it is
        whose = np.maximum(np.cumsum(mine) - 1, 0)
        state, last[end], size[end] = now[whose], place[whose], length[whose]
    return paths(m, lens, last, size)


def paths(m: Model, lens: np.ndarray, last: np.ndarray, size: np.ndarray) -> list[bytes]:
    """The ids along the backpointers from the ends of stretches."""
    at, row, steps = lens, np.arange(len(lens)), []
    while len(row):
        steps.append((row, last[at, row]))
        at = at - size[at, row]
        row, at = row[at > 0], at[at > 0]
    n = np.zeros(len(lens), np.int64)
    for row, _ in steps:
        n[row] += 1
    ends = np.cumsum(n)
    flat = np.zeros(int(ends[-1]), np.int32)
    for k, (row, place) in enumerate(steps):
        flat[ends[row] - 1 - k] = place
    if (flat >= len(m.pieces)).any():  # characters that no piece is
        given = [m.emit(p) for p in flat.tolist()]
        ends = np.cumsum([0, *map(len, given)])[ends]
        flat = np.array([i for g in given for i in g], np.int32)
    data, cuts = flat.tobytes(), [0, *(4 * ends).tolist()]
    return [data[a:b] for a, b in zip(cuts, cuts[1:])]


def learn(model: Model, words: set[str]) -> None:
    """Searches the stretches that aren't remembered, in sorted order, so that one goes on from what it shares with the one
    before."""
    model.forget()
    new = words.difference(model.seen)
    unknown = new.difference(model.older)
    again = list(new - unknown)
    model.remember(again, [model.older[w] for w in again])
    ordered, search, before = sorted(unknown), Stream(model), ""
    most = 2 * model.longest
    short = [w for w in ordered if len(w) <= most] if model.bpe else []
    for word in [w for w in ordered if len(w) > most] if model.bpe else ordered:
        if len(word) > most:
            search._fresh()
            ids, before = search.search(word) + search.close(), ""
        else:
            ids, before = search.go_on(word, before), word
        model.remember([word], [ids])
    for i in range(0, len(short), TOGETHER):
        some = short[i : i + TOGETHER]
        model.remember(some, merge_all(model, some))
    model.widest = max([model.widest, search.widest, *map(len, short)])


def encode_text(model: Model, text: str | None, step: int = BLOCK) -> tuple[bytes, Stream]:
    """The ids of a whole text, streamed through one search, and the search."""
    stream = Stream(model)
    if not text:
        return b"", stream
    out = []
    for i in range(0, len(text), step):
        part = text[i : i + step].replace(" ", MARK)
        out += stream.feed((MARK if model.prefix and not i else "") + part)
    return b"".join(out + stream.finish()), stream


def encode_texts(model: Model, texts: list) -> list[np.ndarray]:
    """The ids of whole texts, each streamed; what the texts of a chunk have in common is searched once beforehand."""
    out: list[np.ndarray] = []
    for a, b in chunks([t or "" for t in texts], AT_ONCE):
        # texts of one block: their stretches are known beforehand. They are split twice, as all at once would take far more
        # memory than the few new ones
        model.forget()
        new: set[str] = set()
        for t in texts[a:b] if model.splitter else []:
            if t and len(t) <= BLOCK:
                new |= set(model.split(t)).difference(model.seen)
        learn(model, new)
        del new
        for t in texts[a:b]:
            ids = b"".join(Stream(model).take(model.split(t))) if t and len(t) <= BLOCK and model.splitter else encode_text(model, t)[0]
            out.append(np.frombuffer(ids, np.int32))
    return out


def decode_ids(model: Model, ids: np.ndarray) -> bytes:
    """UTF-8 of the text that ids stand for."""
    if not len(ids):
        return b""
    n = model.raw_len[ids]
    total = np.cumsum(n)
    out = model.raw[np.repeat(model.raw_at[ids] - total + n, n) + np.arange(total[-1])].tobytes()
    return out[1:] if model.prefix and out[:1] == b" " else out


@lru_cache(maxsize=2)
def _loaded(key: str, data: bytes) -> Model:
    return Model(data)


MODELS.append(_loaded)


def read_model(spark: SparkSession, path: str):
    """The file's bytes, for all executors; a model of more than 64 MB is refused."""
    with open(path, "rb") as f:
        data = f.read()
    if len(data) > 64 << 20:
        raise ValueError("the model is too large to be sent to every executor")
    return spark.sparkContext.broadcast(data)


def encode(docs: DataFrame, model_path: str = MODEL, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a column of ids, which must be a new name, in place of the text column."""
    held = read_model(docs.sparkSession, model_path)

    def run(batches):
        model = _loaded("", held.value)
        for batch in sliced(batches, keeps=_loaded):
            found = encode_texts(model, batch.column(text).to_pylist())
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(ends, np.concatenate([*found, np.zeros(0, np.int32)]))
            names = [n for n in batch.schema.names if n != text]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), lists], [*names, ids])

    rest = [f for f in docs.schema.fields if f.name != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), f"`{ids}` array<int>"])
    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, model_path: str = MODEL, ids: str = "ids", text: str = "text") -> DataFrame:
    """rows with a column of texts in place of the ids."""
    held = read_model(rows.sparkSession, model_path)

    def run(batches):
        model = _loaded("", held.value)
        for batch in sliced(batches, keeps=_loaded):
            texts = [decode_ids(model, np.array(x or [], np.int64)).decode("utf-8", "replace") for x in batch.column(ids).to_pylist()]
            names = [n for n in batch.schema.names if n != ids]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string())], [*names, text])

    rest = [f for f in rows.schema.fields if f.name != ids]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), f"`{text}` string"])
    return rows.mapInArrow(run, schema)


def round_trip(docs: DataFrame, model_path: str = MODEL) -> DataFrame:
    """doc_id, ids, n_ids, and whether decoding the ids gives the text again (with U+2581 read as a space)."""
    held = read_model(docs.sparkSession, model_path)

    def run(batches):
        model = _loaded("", held.value)
        for batch in sliced(batches, keeps=_loaded):
            texts = batch.column("text").to_pylist()
            found = encode_texts(model, texts)
            same = [decode_ids(model, x) == (t or "").replace(MARK, " ").encode() for t, x in zip(texts, found)]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(ends, np.concatenate([*found, np.zeros(0, np.int32)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), lists, pa.array(np.diff(ends).astype(np.int64)), pa.array(same, pa.bool_())],
                ["doc_id", "ids", "n_ids", "round_trip"],
            )

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, ids array<int>, n_ids long, round_trip boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
