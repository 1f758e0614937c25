"""Alignment of two tokenizers' tokens: fragments of byte ranges composed as a monoid, links counted over the corpus."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from itinera.llm.common import once_per_worker
from itinera.plans.tables import TableStore

#: Characters of a range; a longer text is cut into ranges that are aligned in different tasks.
RANGE = 16_384
#: Fragments that one step of the tree composes.
FAN = 16
#: Most id pairs whose counts travel to every task; with more of them the counts are joined by shuffle.
PAIRS = 4_000_000
#: Bytes of segments that a worker remembers.
CACHED = 160 << 20
#: Texts that are looked at together.
TOGETHER = 128

# Between two characters that are no white space, no token of either kind crosses the place before a single space:
# the first pattern takes a space only in front, and no piece of the second has its marker after another character.
_BREAK = re.compile(r"(?<=\S) (?=\S)")
_ODD = re.compile(r" \s|\s ")


def segments(text: str) -> list[str]:
    """A text cut at the spaces that both tokenizers break at; each segment is encoded as space + segment."""
    if _ODD.search(text) or text[:1].isspace() or text[-1:].isspace():
        return _BREAK.split(text)
    return text.split(" ")


def _byte_level() -> dict[str, int]:
    """Bytes of the byte-level alphabet: printable Latin-1 as it is, the others from U+0100 on in turn."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(others)}}


#: Of both vocabularies: the ids of many segments in turn, and how many are each segment's.
Ids = list[tuple[np.ndarray, np.ndarray]]

#: Fixed value: the pattern that byte-level vocabularies cut texts by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Tokenizers:
    """Both vocabularies: ids of segments and the bytes of each id.

    The first is run by the faster of two libraries where its ids are in the
    order of its merges, which then rank them.
    """

    def __init__(self, first: str, second: bytes):
        alphabet, told = _byte_level(), json.loads(first)
        spell = lambda piece: bytes(map(alphabet.__getitem__, piece)) if all(c in alphabet for c in piece) else piece.encode()
        slow = Tokenizer.from_str(first)
        slow.encode_special_tokens = True
        self.bytes_a = {i: spell(piece) for piece, i in slow.get_vocab(True).items()}
        vocab, merges = told["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in told["model"]["merges"]]
        made = [vocab.get("".join(m), -1) for m in merges]
        special = {t["content"] for t in told.get("added_tokens", [])}
        ranks = {spell(piece): i for piece, i in vocab.items() if piece not in special}
        if told["pre_tokenizer"].get("type") == "ByteLevel" and not told["pre_tokenizer"].get("add_prefix_space") and made == sorted(set(made)) \
                and len(made) + 256 == len(ranks) and not told.get("normalizer"):
            self.fast = tiktoken.Encoding("first", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.encode_a = self.fast.encode_ordinary
        else:
            self.fast = None
            self.encode_a = lambda text: slow.encode(text, add_special_tokens=False).ids
        self.b = sentencepiece.SentencePieceProcessor(model_proto=second)
        piece = self.b.id_to_piece
        self.bytes_b = [bytes([int(piece(i)[3:5], 16)]) if self.b.is_byte(i) else piece(i).replace("▁", " ").encode()
                        for i in range(self.b.get_piece_size())]
        self.size_a = [len(self.bytes_a.get(i, b"")) for i in range(max(self.bytes_a) + 1)]
        self.size_b = list(map(len, self.bytes_b))
        self.length_a, self.length_b = np.array(self.size_a), np.array(self.size_b)
        # ids as text with what follows them: at twice an id a comma, one further the end of its side of a group
        self.shown = [f"{i}{mark}" for size, end in ((self.size_a, "|"), (self.size_b, ";")) for i in range(len(size)) for mark in (",", end)]
        self.shown_length = np.fromiter(map(len, self.shown), dtype=np.int64, count=len(self.shown))

    def encode(self, parts: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """Ids of space + segment by both for each segment, None where the tokens' bytes are not the segment's."""
        out, of_a, of_b = [], self.bytes_a.__getitem__, self.bytes_b.__getitem__
        for segment, b in zip(parts, self.b.encode(parts, num_threads=1)):
            spaced = " " + segment
            a, raw = self.encode_a(spaced), spaced.encode()
            out.append((a, b) if b"".join(map(of_a, a)) == raw == b"".join(map(of_b, b)) else None)
        return out

    def together(self, parts: list[str]) -> tuple[list[str], Ids, list[str]]:
        """Segments with their ids, and those whose bytes differ from their tokens'.

        Segments that start and end in no white space are encoded by the first
        vocabulary as one text, which no token crosses a segment's end of.
        """
        joined = [p for p in parts if p and p.strip() == p] if self.fast else []
        ids = self._joined(joined) if joined else None
        good, single = (joined, [p for p in parts if not p or p.strip() != p]) if ids else ([], parts)
        found = list(zip(single, self.encode(single)))
        some = [(p, x) for p, x in found if x]
        rest = [(np.fromiter(chain.from_iterable(x[k] for _, x in some), dtype=np.int64),
                 np.fromiter((len(x[k]) for _, x in some), dtype=np.int64)) for k in (0, 1)]
        both = rest if not ids else [tuple(map(np.concatenate, zip(i, r))) for i, r in zip(ids, rest)]
        return good + [p for p, _ in some], both, [p for p, x in found if not x]

    def _joined(self, parts: list[str]) -> Ids | None:
        """Ids of segments encoded as one text, or None if any of their bytes differ."""
        text = " " + " ".join(parts)
        raw = text.encode()
        ends = np.cumsum(np.fromiter((len(p) if p.isascii() else len(p.encode()) for p in parts), dtype=np.int64, count=len(parts)) + 1)
        pieces = self.b.encode(parts, num_threads=1)
        flat = [self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64), np.fromiter(chain.from_iterable(pieces), dtype=np.int64)]
        out = []
        for ids, size, spelt in zip(flat, (self.length_a, self.length_b), (self.bytes_a, self.bytes_b)):
            at = np.cumsum(size[ids])
            last = np.searchsorted(at, ends)
            if at[-1] != len(raw) or not np.array_equal(at[last], ends) or b"".join(map(spelt.__getitem__, ids.tolist())) != raw:
                return None
            out.append((ids, np.diff(last, prepend=-1)))
        if not np.array_equal(out[1][1], np.fromiter(map(len, pieces), dtype=np.int64, count=len(parts))):
            return None
        return out

    def walk(self, ids: Ids) -> Walk:
        """Links and groups of many segments at once: one after another they are a text that has a common end after each."""
        (a, n_a), (b, _) = ids
        end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        last = end_a[np.cumsum(n_a) - 1]
        shared = end_b[np.searchsorted(end_b, end_a)] == end_a
        common = end_a[shared]
        every = np.sort(np.concatenate([end_a[~shared], end_b]), kind="stable")
        keys = a[np.searchsorted(end_a, every)] << 32 | b[np.searchsorted(end_b, every)]
        per = lambda found: np.diff(np.searchsorted(found, last, side="right"), prepend=0)
        return Walk([a, b], [np.append(0, np.searchsorted(e, common) + 1) for e in (end_a, end_b)], keys, per(every), per(common))

    def texts(self, walk: Walk) -> list[str]:
        """The groups of each segment of a walk as text."""
        (a, b), (cut_a, cut_b) = walk.flat, walk.cuts
        first, second = 2 * a, 2 * b + 2 * len(self.size_a)
        first[cut_a[1:] - 1] += 1
        second[cut_b[1:] - 1] += 1
        order = np.empty(len(a) + len(b), dtype=np.int64)
        order[np.arange(len(a)) + np.repeat(cut_b[:-1], np.diff(cut_a))] = first
        order[np.arange(len(b)) + np.repeat(cut_a[1:], np.diff(cut_b))] = second
        text = "".join(map(self.shown.__getitem__, order.tolist()))
        groups = np.cumsum(walk.groups)
        ends = np.cumsum(self.shown_length[order])[cut_a[groups] + cut_b[groups] - 1].tolist()
        return [text[i:j - 1] for i, j in zip([0, *ends], ends)]


@dataclass(frozen=True)
class Walk:
    """Many segments in turn: ids of both, where groups are cut in them, pair keys of the links, links and groups of each segment."""
    flat: list[np.ndarray]
    cuts: list[np.ndarray]
    keys: np.ndarray
    links: np.ndarray
    groups: np.ndarray


# --------------------------------------------------------------------------------------------- the monoid

@dataclass(frozen=True)
class Fragment:
    """What is known of a byte range: tokens up to its first common end, the closed groups after it, the tokens after its last.

    Without a common end (``cut`` false) all tokens are in the head. Counts
    belong to the range in which a token, a common end or a link ends, so they
    add up.
    """
    cut: bool = False
    head: tuple[tuple[int, ...], tuple[int, ...]] = ((), ())
    closed: str = ""
    tail: tuple[tuple[int, ...], tuple[int, ...]] = ((), ())
    counts: tuple[int, ...] = (0,) * 6  # tokens of A and B, groups, links, best links, sum of counts

    def __add__(self, other: Fragment) -> Fragment:
        """The fragment of both ranges in turn; the operation is associative and ``Fragment()`` its unit."""
        counts = tuple(x + y for x, y in zip(self.counts, other.counts))
        join = lambda x, y: (x[0] + y[0], x[1] + y[1])
        if not self.cut:
            return Fragment(other.cut, join(self.head, other.head), other.closed, other.tail, counts)
        if not other.cut:
            return Fragment(True, self.head, self.closed, join(self.tail, other.head), counts)
        middle = group_text(*join(self.tail, other.head))
        closed = ";".join(filter(None, (self.closed, middle, other.closed)))
        return Fragment(True, self.head, closed, other.tail, counts)

    def groups(self) -> str:
        """The groups of a whole text, which ends at a common end."""
        return ";".join(filter(None, (group_text(*self.head), self.closed))) if self.cut else ""


def group_text(a, b) -> str:
    return f"{','.join(map(str, a))}|{','.join(map(str, b))}"


@dataclass(frozen=True)
class Aligned:
    """Tokens of a piece of text that starts and ends at a common end."""
    a: list[int]
    b: list[int]
    end_a: np.ndarray
    end_b: np.ndarray

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(A id, B id, end) of each overlapping pair: one between any two neighbouring token ends of either kind."""
        ends = np.union1d(self.end_a, self.end_b)
        return (np.asarray(self.a, dtype=np.int64)[np.searchsorted(self.end_a, ends)],
                np.asarray(self.b, dtype=np.int64)[np.searchsorted(self.end_b, ends)], ends)


def aligned(tokenizers: Tokenizers, segment: str) -> Aligned | None:
    """Tokens of space + segment with their ends, or None where the tokens' bytes are not the segment's."""
    (ids,) = tokenizers.encode([segment])
    if ids is None:
        return None
    ends = lambda found, size: np.cumsum([size[i] for i in found])
    return Aligned(*ids, ends(ids[0], tokenizers.size_a), ends(ids[1], tokenizers.size_b))


def fragment(text: Aligned, low: int, high: int, weigh) -> Fragment:
    """The fragment of the bytes (low, high] of an aligned text; ``weigh`` gives best links and sum of counts of id pairs."""
    a0, a1 = np.searchsorted(text.end_a, [low, high], side="right")
    b0, b1 = np.searchsorted(text.end_b, [low, high], side="right")
    common = np.intersect1d(text.end_a[a0:a1], text.end_b[b0:b1], assume_unique=True)
    first, second, ends = text.links()
    here = (ends > low) & (ends <= high)
    best, count = weigh(first[here] << 32 | second[here])
    counts = (int(a1 - a0), int(b1 - b0), len(common), int(here.sum()), int(best.sum()), int(count.sum()))
    if not len(common):
        return Fragment(False, (tuple(text.a[a0:a1]), tuple(text.b[b0:b1])), counts=counts)
    cut_a, cut_b = np.searchsorted(text.end_a, common) + 1, np.searchsorted(text.end_b, common) + 1
    closed = ";".join(group_text(text.a[i:j], text.b[k:m]) for i, j, k, m in zip(cut_a, cut_a[1:], cut_b, cut_b[1:]))
    return Fragment(True, (tuple(text.a[a0:cut_a[0]]), tuple(text.b[b0:cut_b[0]])), closed,
                    (tuple(text.a[cut_a[-1]:a1]), tuple(text.b[cut_b[-1]:b1])), counts)


def no_weights(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    nothing = np.zeros(len(keys), dtype=np.int64)
    return nothing, nothing


class Weights:
    """Counts of id pairs: sorted keys, their counts, and whether a count is the highest of its B id."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order]
        b = self.keys & 0xFFFFFFFF
        most = np.zeros(int(b.max()) + 1 if len(b) else 1, dtype=np.int64)
        np.maximum.at(most, b, self.counts)
        self.best = (self.counts == most[b]).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, keys)
        return self.best[at], self.counts[at]


# ------------------------------------------------------------------------------------------------- ranges

def ranges(text: str, size: int) -> Iterator[tuple[str, int, int]]:
    """(slice, low, high): bytes (low, high] of space + slice are the slice's own range.

    Ranges end every ``size`` characters, wherever that is; a slice reaches from
    the last break of both tokenizers before its range to the first one behind,
    so its tokens are those of the whole text. A segment is cut once at the most.
    """
    if len(text) <= size:
        yield text, 0, 1 + len(text.encode())
        return
    starts = np.array([0] + [m.start() + 1 for m in _BREAK.finditer(text)])  # where segments start; the space before is theirs
    ends = np.append(starts[1:] - 1, len(text))
    borders, last = [], -1
    for border in range(size, len(text), size):
        k = int(np.searchsorted(starts, border, side="right")) - 1
        if k > last and border < ends[k]:
            borders.append((border, k))
            last = k
    low, k = 0, 0
    for border, m in [*borders, (len(text), len(starts) - 1)]:
        piece = text[starts[k]:ends[m]]
        before = 1 + len(text[starts[k]:low].encode()) if low else 0
        yield piece, before, 1 + len(text[starts[k]:border].encode())
        low, k = border, m


class Aligner(dict):
    """Fragments of slices; of whole segments the groups and counts are remembered by number (None where the bytes differ)."""

    def __init__(self, tokenizers: Tokenizers, weigh):
        super().__init__()
        self.tokenizers, self.weigh = tokenizers, weigh
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.texts, self.counts, self.held = [], np.zeros((1024, 6), dtype=np.int64), 0

    def learn(self, parts: set[str]) -> None:
        """Remember segments, encoded and weighed together."""
        if self.held > CACHED:
            self.forget()
        fresh, ids, unlike = self.tokenizers.together(list(parts - self.keys()))
        self.update(dict.fromkeys(unlike))
        if not fresh:
            return
        walk = self.tokenizers.walk(ids)
        first = np.cumsum(walk.links) - walk.links
        low, high = len(self.texts), len(self.texts) + len(fresh)
        while high > len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
        self.counts[low:high] = np.column_stack([ids[0][1], ids[1][1], walk.groups, walk.links,
                                                 *[np.add.reduceat(x, first) for x in self.weigh(walk.keys)]])
        texts = self.tokenizers.texts(walk)
        self.texts += texts
        self.update(zip(fresh, range(low, high)))
        self.held += 300 * len(fresh) + sum(map(len, fresh)) + sum(map(len, texts))

    def __missing__(self, segment: str) -> int | None:
        self.learn({segment})
        return self[segment]

    def inside(self, parts: list[str]) -> Fragment | None:
        """The fragment of whole segments in turn, each of which starts and ends at a common end."""
        found = list(map(self.__getitem__, parts))
        if None in found:
            return None
        total = self.counts[found].sum(axis=0)
        texts = list(map(self.texts.__getitem__, found))
        first, _, rest = texts[0].partition(";")
        a, b = (tuple(map(int, side.split(","))) for side in first.split("|"))
        closed = ";".join([rest, *texts[1:]] if rest else texts[1:])
        return Fragment(True, (a, b), closed, counts=tuple(total.tolist()))

    def part(self, piece: str, low: int, high: int) -> Fragment | None:
        """The fragment of the bytes (low, high] of space + piece; None if the bytes differ."""
        parts = segments(piece)
        size = [1 + len(p.encode()) for p in parts]
        bounds = np.cumsum([0] + size)
        out = Fragment()
        k = 0
        while k < len(parts):
            start, end = int(bounds[k]), int(bounds[k + 1])
            if end <= low or start >= high:  # a segment of the neighbour's alone
                k += 1
            elif start >= low and end <= high:
                m = k + 1
                while m < len(parts) and bounds[m + 1] <= high:
                    m += 1
                inside = self.inside(parts[k:m])
                if inside is None:
                    return None
                out, k = out + inside, m
            else:
                text = aligned(self.tokenizers, parts[k])
                if text is None:
                    return None
                out, k = out + fragment(text, max(low - start, 0), min(high, end) - start, self.weigh), k + 1
        return out


# ------------------------------------------------------------------------------------------------- Spark

def _tokenizers(vocabularies, key: str) -> Tokenizers:
    return once_per_worker(key, lambda: Tokenizers(*vocabularies.value))


def _ranges_of(batches, size: int):
    """A row for each range of a long text."""
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            cut = list(ranges(text, size))
            for i in range(0, len(cut), 64):
                part = cut[i:i + 64]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(part), pa.int64()), pa.array(range(i, i + len(part)), pa.int64()),
                     pa.array([p for p, _, _ in part]), pa.array([lo for _, lo, _ in part], pa.int64()),
                     pa.array([hi for _, _, hi in part], pa.int64())], ["key", "place", "text", "low", "high"])


class LinkCounts:
    """Links of a task's texts, added up by segment before they are looked at one by one."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers, self.seen, self.known, self.unlike = tokenizers, Counter(), {}, set()
        self.keys, self.links, self.held = [], [], 0

    def add(self, texts: list[list[str]]) -> None:
        """Count the segments of texts; those of a text whose bytes differ count nothing."""
        fresh, ids, unlike = self.tokenizers.together(list(set().union(*texts) - self.known.keys() - self.unlike))
        self.unlike.update(unlike)
        if fresh:
            self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh))))
            walk = self.tokenizers.walk(ids)
            self.keys.append(walk.keys)
            self.links.append(walk.links)
            self.held += 250 * len(fresh) + 4 * sum(map(len, fresh)) + 8 * len(walk.keys)
        for parts in texts:
            if not self.unlike or self.unlike.isdisjoint(parts):
                self.seen.update(parts)

    def taken(self) -> pa.RecordBatch:
        """(pair, n) of what was added since the last time."""
        n = np.zeros(len(self.known), dtype=np.int64)
        n[[self.known[s] for s in self.seen]] = list(self.seen.values())
        keys = np.concatenate(self.keys or [n])
        pairs, place = np.unique(keys, return_inverse=True)
        sums = np.zeros(len(pairs), dtype=np.int64)
        np.add.at(sums, place, np.repeat(n, np.concatenate(self.links or [n])))
        self.__init__(self.tokenizers)
        return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(sums)], ["pair", "n"])


def _pair_counts(batches, vocabularies, key: str):
    """(pair, n) of the task's texts."""
    counts = LinkCounts(_tokenizers(vocabularies, key))
    for batch in batches:
        for low in range(0, batch.num_rows, TOGETHER):
            counts.add([segments(t) for t in batch.column(0).slice(low, TOGETHER).to_pylist()])
            if counts.held > CACHED:
                yield counts.taken()
    yield counts.taken()


_RESULT = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
_NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def _row(found: tuple[str, tuple[int, ...]] | None) -> tuple:
    return (*found[1], hashlib.sha256(found[0].encode()).hexdigest()) if found is not None else (0,) * 6 + ("",)


def _columns(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array([r[i] for r in rows], pa.int64()) for i in range(6)] + [pa.array([r[6] for r in rows], pa.string())]


def _short(batches, vocabularies, key: str, weights):
    aligner = once_per_worker(key + "w", lambda: Aligner(_tokenizers(vocabularies, key), weights.value if weights else no_weights))
    for batch in batches:
        for low in range(0, batch.num_rows, TOGETHER):
            rows = batch.slice(low, TOGETHER)
            texts = [segments(t) if t else None for t in rows.column(1).to_pylist()]
            aligner.learn(set().union(*filter(None, texts)))
            found = [aligner.inside(parts) if parts else None for parts in texts]
            out = [_row((f.groups(), f.counts) if f else None) for f in found]
            yield pa.RecordBatch.from_arrays([rows.column(0), *_columns(out)], ["doc_id", *_NAMES])


_FRAGMENT = ("key bigint, place bigint, same boolean, cut boolean, head_a array<bigint>, head_b array<bigint>, closed string, "
             "tail_a array<bigint>, tail_b array<bigint>, counts array<bigint>")


def _fragment_rows(keys: list, places: list, found: list[Fragment | None]) -> pa.RecordBatch:
    some = [f if f is not None else Fragment() for f in found]
    many = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int64()), pa.array(places, pa.int64()), pa.array([f is not None for f in found]), pa.array([f.cut for f in some]),
         pa.array([f.head[0] for f in some], many), pa.array([f.head[1] for f in some], many), pa.array([f.closed for f in some], pa.string()),
         pa.array([f.tail[0] for f in some], many), pa.array([f.tail[1] for f in some], many), pa.array([f.counts for f in some], many)],
        [c.strip().split(" ")[0] for c in _FRAGMENT.split(", ")])


def _parts(batches, vocabularies, key: str, weights):
    aligner = once_per_worker(key + "w", lambda: Aligner(_tokenizers(vocabularies, key), weights.value if weights else no_weights))
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            rows = batch.slice(i, 64).to_pydict()
            aligner.learn(set(chain.from_iterable(map(segments, rows["text"]))))
            found = [aligner.part(t, lo, hi) for t, lo, hi in zip(rows["text"], rows["low"], rows["high"])]
            yield _fragment_rows(rows["key"], rows["place"], found)


def _composed(table: pa.Table, fan: int) -> pa.Table:
    """Fragments of neighbouring places as one."""
    rows = sorted(table.to_pylist(), key=lambda r: r["place"])
    total = Fragment()
    for r in rows:
        total = total + Fragment(r["cut"], (tuple(r["head_a"]), tuple(r["head_b"])), r["closed"], (tuple(r["tail_a"]), tuple(r["tail_b"])),
                                 tuple(r["counts"]))
    same = all(r["same"] for r in rows)
    return pa.Table.from_batches([_fragment_rows([rows[0]["key"]], [rows[0]["place"] // fan], [total if same else None])])


def _finished(batches):
    for batch in batches:
        rows = batch.to_pydict()
        out = []
        for k in range(batch.num_rows):
            f = Fragment(rows["cut"][k], (tuple(rows["head_a"][k]), tuple(rows["head_b"][k])), rows["closed"][k], counts=tuple(rows["counts"][k]))
            out.append(_row((f.groups(), f.counts) if rows["same"][k] else None))
        yield pa.RecordBatch.from_arrays([batch.column(0), *_columns(out)], ["key", *_NAMES])


def compose(fragments: DataFrame, store: TableStore, fan: int = FAN) -> DataFrame:
    """One fragment for each key: steps of a tree, each composing ``fan`` neighbours, until every text is one."""
    k = 0
    while True:
        k += 1
        step = fragments.groupBy("key", F.floor(F.col("place") / fan).alias("next")).applyInArrow(lambda t: _composed(t, fan), _FRAGMENT)
        fragments, seen = store.write(step, f"composed-{k}", most=F.max("place"))
        if not seen["most"]:
            return fragments


def _doc_pairs(batches, vocabularies, key: str):
    """(key, pair, n) of every text: how often it links a pair."""
    counts = LinkCounts(_tokenizers(vocabularies, key))
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts.add([segments(text)])
            out = counts.taken()
            out = out.filter(pc.greater(out.column(1), 0))
            if out.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([doc] * out.num_rows, pa.int64()), *out.columns], ["key", "pair", "n"])


def align(docs: DataFrame, first: str, second: str, id_column: str = "doc_id", text_column: str = "text", size: int = RANGE,
          most_pairs: int = PAIRS, fan: int = FAN) -> DataFrame:
    """Alignment of two tokenizers on every text: (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256).

    ``first`` is the file of a byte-level vocabulary, ``second`` of a piece
    model with byte fallback; both are read on the driver. A text is encoded
    as space + text without special tokens. Byte offsets at which tokens of
    both end cut it into groups; links are the pairs of tokens that overlap. A
    pair's count is the number of links of its ids in the whole corpus;
    ``n_best`` are links whose pair no other of the same second id exceeds.

    Links are counted in one pass, by segment and task before they shuffle, and
    texts are aligned in another. A text longer than ``size`` characters is cut
    into byte ranges that go to different tasks; each gives the open tokens
    before its first common end, closed groups and open tokens after the last,
    and a tree of joins by neighbours composes them. The pair counts travel to all
    tasks if there are at most ``most_pairs``; else they are joined by shuffle.

    Null and empty texts and texts whose tokens' bytes differ from theirs have
    no tokens: zeros and an empty digest; they count nothing. Null and repeated
    ids stay, a row for each; other columns are not looked at; no rows give no rows.
    """
    spark = docs.sparkSession
    store = TableStore(spark, "alignment")
    with open(first, encoding="utf-8") as f, open(second, "rb") as g:
        vocabularies = spark.sparkContext.broadcast((f.read(), g.read()))
    key = uuid.uuid4().hex
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    is_long = F.length("text") > size
    own = F.xxhash64("doc_id", "text")
    counted = (rows.filter("text != ''").select("text").mapInArrow(lambda b: _pair_counts(b, vocabularies, key), "pair bigint, n bigint")
               .groupBy("pair").agg(F.sum("n").alias("n")))
    pairs, seen = store.write(counted, "pairs", n=F.count(F.lit(1)))
    travels = seen["n"] <= most_pairs
    weights = None
    if travels:
        held = pairs.toArrow()
        weights = spark.sparkContext.broadcast(Weights(held.column("pair").to_numpy(), held.column("n").to_numpy()))
    short = rows.filter(~is_long).mapInArrow(lambda b: _short(b, vocabularies, key, weights), f"doc_id {kind}, {_RESULT}") if travels else \
        rows.filter(~is_long).select(own.alias("key"), "text").mapInArrow(lambda b: _short(b, vocabularies, key, None), f"doc_id bigint, {_RESULT}")
    long, n_long = store.write(rows.filter(is_long).select("doc_id", own.alias("key"), "text"), "long", n=F.count(F.lit(1)))
    parts = []
    if n_long["n"]:
        cut = long.select("key", "text").dropDuplicates(["key"]).mapInArrow(
            lambda b: _ranges_of(b, size), "key bigint, place bigint, text string, low bigint, high bigint")
        fragments, _ = store.write(cut.repartition("key", "place").mapInArrow(lambda b: _parts(b, vocabularies, key, weights), _FRAGMENT), "fragments")
        whole = compose(fragments, store, fan).mapInArrow(_finished, f"key bigint, {_RESULT}")
        parts = [whole]
    if travels:
        return short.unionByName(long.select("doc_id", "key").join(parts[0], "key").drop("key")) if parts else short
    most = pairs.groupBy(F.expr("pair & 4294967295L").alias("b")).agg(F.max("n").alias("most"))
    graded = (pairs.withColumn("b", F.expr("pair & 4294967295L")).join(most, "b")
              .select("pair", F.col("n").alias("count"), (F.col("n") == F.col("most")).cast("bigint").alias("best")))
    mine = rows.filter("text != ''").select(own.alias("key"), "text").dropDuplicates(["key"]) \
        .mapInArrow(lambda b: _doc_pairs(b, vocabularies, key), "key bigint, pair bigint, n bigint")
    sums = mine.join(graded, "pair").groupBy("key").agg(F.sum(F.col("n") * F.col("best")).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    found = short.withColumnRenamed("doc_id", "key").dropDuplicates(["key"])
    found = found.unionByName(parts[0]) if parts else found
    full = found.drop("n_best", "count_sum").join(sums, "key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("doc_id", own.alias("key")).join(full, "key").select("doc_id", *[zero(c) if c in ("n_best", "count_sum") else F.col(c) for c in _NAMES])
