"""Byte-level BPE by corpus-level merge replay.

The pre-tokens of a block of documents form a corpus of distinct words.  All words' byte tokens lie in one linked
sequence; an inverted index leads from each adjacent token pair to the places where it occurs.  Merges are replayed
in rank order over the whole corpus: each one visits only the places listed under its pair and touches only the two
neighbours there.  A word is thus encoded once per block however often it occurs, and words already known to the task
(a bounded memo) are not replayed again.

The rank file is read from a path parameter on each executor, never copied or shipped through the driver.  No
shuffle: documents are encoded and decoded where they are read, and memory is bounded by the block and the memo.

Defined cases: a null text encodes to no tokens and decodes to no bytes; a null ``doc_id`` is carried through;
repeated rows give repeated results; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Distinct words that a Python worker keeps encoded from block to block.
MEMO_WORDS = 1_000_000
#: Token pairs whose merge it remembers.
MEMO_PAIRS = 1_000_000
#: A token pair is one integer: the left id shifted by so many bits, then the right id.
_SHIFT = 24
_MASK = (1 << _SHIFT) - 1
#: Shorter lists of places are merged one by one.
_FEW = 24
#: Characters of text that make up one corpus for the replay.
BLOCK_CHARS = 16_000_000


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 token and rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class MergeReplay:
    """Encodes sets of words by replaying merges over all of them at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.known: dict[int, int] = {}
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def pair_rank(self, pair: int) -> int:
        """Rank of the token that two adjacent tokens merge into, -1 if there is none."""
        rank = self.known.get(pair)
        if rank is None:
            rank = self.ranks.get(self.tokens[pair >> _SHIFT] + self.tokens[pair & _MASK], -1)
            self.known[pair] = rank
        return rank

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The words' token ids one after another, and how many each word has."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(self.known) > MEMO_PAIRS:
            self.known.clear()
        whole = np.fromiter((self.ranks.get(w, -1) for w in words), np.int64, len(words))  # a word that is a token stays one
        known = whole >= 0
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        lengths[known] = 1
        at_known = np.repeat(known, lengths)
        first = np.empty(len(at_known), np.int64)
        first[at_known] = whole[known]
        rest = b"".join([w for w, k in zip(words, known.tolist(), strict=True) if not k])
        first[~at_known] = self.byte_id[np.frombuffer(rest, np.uint8)]
        return _Corpus(self, first, lengths).replay()


class _Corpus:
    """The words of one block as a linked token sequence with its inverted index of pairs."""

    def __init__(self, merges: MergeReplay, first: np.ndarray, lengths: np.ndarray):
        self.merges = merges
        self.ends = np.cumsum(lengths + 1) - 1  # after each word a token of -1 parts it from the next
        size = int(self.ends[-1]) + 1
        token = np.full(size, -1, np.int64)
        inside = np.ones(size, bool)
        inside[self.ends] = False
        token[inside] = first
        self.token = token
        self.after = np.minimum(np.arange(1, size + 1), size - 1)
        self.before = np.arange(-1, size - 1)  # -1 reads the last token, which is -1 too
        self.views = memoryview(self.token), memoryview(self.after), memoryview(self.before)  # single values, read fast
        self.index: dict[int, list[np.ndarray | int]] = {}
        self.queue: list[tuple[int, int]] = []
        places = np.flatnonzero(inside[:-1] & inside[1:])
        self.add((token[places] << _SHIFT) | token[places + 1], places)

    def add(self, pairs: np.ndarray, places: np.ndarray) -> None:
        """Lists the places under their pairs; pairs without a merge are left out."""
        order = np.argsort(pairs, kind="stable")
        pairs, places = pairs[order], places[order]
        cuts = np.flatnonzero(pairs[1:] != pairs[:-1]) + 1
        heads = pairs[np.concatenate(([0], cuts))].tolist() if len(pairs) else []
        cuts = [0, *cuts.tolist(), len(pairs)]
        known, index = self.merges.known, self.index
        for n, pair in enumerate(heads):
            rank = known.get(pair)
            if rank is None:
                rank = self.merges.pair_rank(pair)
            if rank < 0:
                continue
            if pair in index:
                index[pair].append(places[cuts[n] : cuts[n + 1]])
            else:
                index[pair] = [places[cuts[n] : cuts[n + 1]]]
                heappush(self.queue, (rank, pair))

    def replay(self) -> tuple[np.ndarray, np.ndarray]:
        """Applies every merge in rank order; the ids that are left, and how many each word has."""
        index, queue = self.index, self.queue
        while queue:
            rank, pair = heappop(queue)
            found = index.pop(pair, None)
            if not found:
                continue
            places = [x for x in found if type(x) is int]
            arrays = [x for x in found if type(x) is not int]
            if sum(map(len, arrays)) + len(places) < _FEW:
                self.one_by_one(rank, pair, sorted(itertools.chain(places, *(x.tolist() for x in arrays))))
            elif len(found) == 1:
                self.together(rank, pair, arrays[0])
            else:
                self.together(rank, pair, np.sort(np.concatenate((np.array(places, np.int64), *arrays))))
        left = self.token >= 0
        return self.token[left], np.diff(np.cumsum(left)[self.ends], prepend=0)

    def together(self, rank: int, pair: int, places: np.ndarray) -> None:
        """Merges all places of a pair at once, as far as their order can't matter."""
        token, after, before = self.token, self.after, self.before
        a, b = pair >> _SHIFT, pair & _MASK
        if a == b:
            return self.one_by_one(rank, pair, places.tolist())
        places = places[token[places] == a]
        right = after[places]
        ok = token[right] == b
        places, right = places[ok], right[ok]
        if not len(places):
            return None
        if (places[1:] == places[:-1]).any():
            keep = np.concatenate(([True], places[1:] != places[:-1]))
            places, right = places[keep], right[keep]
        beyond, left = after[right], before[places]
        next_token, last_token = token[beyond], token[left]
        touching = (next_token == a) & (token[after[beyond]] == b)
        if touching.any():  # such as "haha": the places share a neighbour
            touching |= np.isin(places, beyond[touching])
            rest = places[touching]
            apart = ~touching
            places, right, beyond, left = places[apart], right[apart], beyond[apart], left[apart]
            next_token, last_token = next_token[apart], last_token[apart]
        else:
            rest = None
        has_next, has_last = next_token >= 0, last_token >= 0
        pairs = np.concatenate(((rank << _SHIFT) | next_token[has_next], (last_token[has_last] << _SHIFT) | rank))
        for new in set(pairs.tolist()):
            r = self.merges.known.get(new)
            if r is None:
                r = self.merges.pair_rank(new)
            if 0 <= r < rank:  # an earlier merge becomes possible: order matters
                return self.one_by_one(rank, pair, sorted([*places.tolist(), *([] if rest is None else rest.tolist())]))
        token[places] = rank
        token[right] = -2
        after[places] = beyond
        before[beyond] = places
        self.add(pairs, np.concatenate((places[has_next], left[has_last])))
        if rest is not None:
            self.one_by_one(rank, pair, rest.tolist())
        return None

    def one_by_one(self, rank: int, pair: int, places: list[int]) -> None:
        """Merges the places of a pair from left to right."""
        token, after, before = self.views
        index, queue = self.index, self.queue
        a, b = pair >> _SHIFT, pair & _MASK
        known, pair_rank = self.merges.known, self.merges.pair_rank
        for n, place in enumerate(places):
            if token[place] != a:
                continue
            right = after[place]
            if token[right] != b:
                continue
            beyond, left = after[right], before[place]
            token[place] = rank
            token[right] = -2
            after[place] = beyond
            before[beyond] = place
            lower = False
            following, last = token[beyond], token[left]
            for at, new in ((place, (rank << _SHIFT) | following if following >= 0 else -1), (left, (last << _SHIFT) | rank if last >= 0 else -1)):
                if new < 0:
                    continue
                r = known.get(new)
                if r is None:
                    r = pair_rank(new)
                if r < 0:
                    continue
                if new in index:
                    index[new].append(at)
                else:
                    index[new] = [at]
                    heappush(queue, (r, new))
                lower = lower or r < rank
            if lower and n + 1 < len(places):  # an earlier merge became possible: it goes before the other places
                if pair in index:
                    index[pair] += places[n + 1 :]
                else:
                    index[pair] = list(places[n + 1 :])
                    heappush(queue, (rank, pair))
                return


def latin1_pattern(pattern: str) -> str:
    """The pattern for :mod:`re`, equal to the given one on texts of characters below 256.

    The standard library knows no ``\\p{L}``; below 256 each class is a short list of characters, which it
    matches faster.
    """
    text = [chr(c) for c in range(256)]
    classes = {
        name: "".join(f"\\x{ord(c):02x}" for c in text if regex.fullmatch(name, c))
        for name in (r"\p{L}", r"\p{N}", r"\s", r"\S")
    }
    out, inside, at = [], False, 0
    while at < len(pattern):
        name = next((n for n in classes if pattern.startswith(n, at)), None)
        if name:
            out.append(classes[name] if inside else f"[{classes[name]}]")
            at += len(name)
            continue
        size = 2 if pattern[at] == "\\" else 1
        if size == 1:
            inside = (inside or pattern[at] == "[") and pattern[at] != "]"
        out.append(pattern[at : at + size])
        at += size
    return "".join(out)


class Table:
    """Variable-length entries in one flat array, looked up many at a time; more can be added behind."""

    def __init__(self, flat: np.ndarray, counts: np.ndarray):
        self.flat, self.counts = flat, counts.astype(np.int32)
        self.starts = np.cumsum(self.counts, dtype=np.int64) - self.counts
        self.size, self.used = len(counts), len(flat)

    def extend(self, flat: np.ndarray, counts: np.ndarray) -> None:
        """Adds entries behind the present ones; the arrays double when they are full, so adding is cheap."""
        starts = self.used + np.cumsum(counts, dtype=np.int64) - counts
        self.flat = _put(self.flat, self.used, flat)
        self.counts = _put(self.counts, self.size, counts)
        self.starts = _put(self.starts, self.size, starts)
        self.size, self.used = self.size + len(counts), self.used + len(flat)

    def take(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries one after another, and how long each is."""
        counts = self.counts[entries]
        ends = np.cumsum(counts, dtype=np.int64)
        places = np.arange(ends[-1] if len(ends) else 0)
        places += np.repeat(self.starts[entries] - (ends - counts), counts)
        return self.flat[places], counts


def _put(buffer: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """The buffer with ``more`` behind its first ``used`` values; the same one if it has room."""
    if used + len(more) > len(buffer):
        buffer = np.concatenate((buffer[:used], np.empty(max(used, len(more)), buffer.dtype)))
    buffer[used : used + len(more)] = more
    return buffer


class CorpusEncoder:
    """Pre-tokenises texts and encodes them block by block with a bounded memo of words."""

    def __init__(self, ranks_path: str, pattern: str, memo_words: int = MEMO_WORDS):
        self.replay = MergeReplay(load_ranks(ranks_path))
        self._any = regex.compile(pattern).findall
        self._latin1 = re.compile(latin1_pattern(pattern)).findall
        self.memo_words = memo_words
        tokens = [self.replay.tokens.get(i, b"") for i in range(max(self.replay.tokens) + 1)]
        self.token_bytes = Table(np.frombuffer(b"".join(tokens), np.uint8), np.array([len(x) for x in tokens]))
        self._decimals: Table | None = None
        self.reset()

    def reset(self) -> None:
        """Forgets all words."""
        self.vocabulary: defaultdict[str, int] = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__  # a new word gets the next number
        self.ids = Table(np.zeros(0, np.int32), np.zeros(0, np.int32))

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a text."""
        return (self._latin1 if is_latin1(text) else self._any)(text)

    def number(self, words: list[str]) -> np.ndarray:
        """The pre-tokens as entries of ``ids``; new ones are encoded by the next :meth:`learn`."""
        return np.fromiter(map(self.vocabulary.__getitem__, words), np.int32, len(words))

    def make_room(self) -> None:
        """Forgets all words once there are too many; entries handed out before are void then."""
        if len(self.vocabulary) > self.memo_words:
            self.reset()

    def words(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's pre-tokens as entries of ``ids``; words not met before are encoded together."""
        self.make_room()
        per_text = [self.number(self.split(text)) for text in texts]
        self.learn()
        return per_text

    def learn(self) -> None:
        """Replays the merges over the words that got numbers since the last time."""
        new = list(itertools.islice(reversed(self.vocabulary), len(self.vocabulary) - self.ids.size))
        if new:
            self.ids.extend(*self.replay.encode([w.encode("utf-8", "surrogatepass") for w in reversed(new)]))

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Token ids of each text."""
        for block in by_size(texts):
            for entries in self.words(block):
                yield self.ids.take(entries)[0]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes that the ids stand for."""
        return self.token_bytes.take(ids)[0].tobytes()

    def decimal(self, ids: np.ndarray) -> bytes:
        """The ids as decimal numbers joined by one space."""
        if self._decimals is None:
            texts = [b"%d " % i for i in range(len(self.token_bytes.counts))]
            self._decimals = Table(np.frombuffer(b"".join(texts), np.uint8), np.array([len(x) for x in texts]))
        return self._decimals.take(ids)[0].tobytes()[:-1]


@lru_cache(maxsize=1)
def shared_encoder(ranks_path: str, pattern: str) -> CorpusEncoder:
    """The encoder of this Python worker: later tasks start with the words that earlier ones met."""
    return CorpusEncoder(ranks_path, pattern)


def is_latin1(text: str) -> bool:
    """Whether all characters are below 256."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def by_size(texts: list[str], chars: int = BLOCK_CHARS) -> Iterator[list[str]]:
    """Consecutive texts in lists of about ``chars`` characters and at least one text."""
    block: list[str] = []
    size = 0
    for text in texts:
        if block and size + len(text) > chars:
            yield block
            block, size = [], 0
        block.append(text)
        size += len(text)
    if block:
        yield block


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id``, ``ids`` (array of int) and ``decoded`` (the ids' bytes) of every whole text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared_encoder(ranks_path, pattern)
        for batch in batches:
            done = 0
            for block in by_size([t or "" for t in batch.column(1).to_pylist()]):
                ids = list(coder.encode(block))
                flat = pa.array(np.concatenate(ids).astype(np.int32))
                offsets = pa.array(np.cumsum([0, *map(len, ids)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(done, len(block)),
                        pa.ListArray.from_arrays(offsets, flat),
                        pa.array([coder.decode(x) for x in ids], pa.binary()),
                    ],
                    ["doc_id", "ids", "decoded"],
                )
                done += len(block)

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digest_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` and SHA-256 digests of the ids (decimal, joined by a space) and of the decoded bytes.

    Same coder as :func:`encode_documents`; the digests are taken in the same task so the ids never leave it.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared_encoder(ranks_path, pattern)
        sha = hashlib.sha256
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            for ids in coder.encode([t or "" for t in batch.column(1).to_pylist()]):
                counts.append(len(ids))
                of_ids.append(sha(coder.decimal(ids)).hexdigest())
                of_bytes.append(sha(coder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
