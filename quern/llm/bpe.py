"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming decoder.

Merging by rank gives every byte string exactly one token sequence, and a sequence is that one if and
only if each pair of neighbours is: merging the two tokens' bytes gives back just those two. So the
encoder is a nondeterministic transducer: it may end a token wherever the bytes since the last one form
one, and go on from there. What it reads of a prefix is the set of nodes of the vocabulary's trie that
the prefix's suffixes reach; these subsets are determinised lazily, as texts need them. As every prefix
has one token sequence, one token of the subset ends it: the one that may follow the token that ends
where it begins. The last tokens of the prefixes are the transducer's register, as long as the longest
token looks back. Open paths that trace back to one place settle all tokens before it, which are then
emitted: at a piece's end, in a long piece after every window. Transitions, pairs of tokens and pieces
are kept in tables that are cleared at a size limit; results don't depend on what is kept.

Texts are cut into pieces by the tokenizer's pattern. In the pattern of ``public_tokenizers`` a space
before a visible character always begins a piece, so under that pattern texts are cut there first, and
each distinct chunk of a batch is encoded once. Under any other pattern, chunks are whole texts.

The decoder gathers the tokens' bytes; over a stream it holds back at most three bytes, those of a
character still incomplete, by a state machine over lead and continuation bytes.

Defined cases: a null or empty text has no tokens. Unknown ids raise. Other columns pass through.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from quern.llm.common import keeps, lean, only, pieces, with_columns

#: The pattern under which texts may be cut before a space; fixed by the vocabularies that it belongs to.
SPACED_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What is surely visible after a space.
_VISIBLE = "^[!-~¡-¬®-ɏ]"
#: Chunks of letters alone, which are one piece.
_WORDS = "^ ?[A-Za-zÀ-ÖØ-öø-ɏ]+$"


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a file of base64 and rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Merges:
    """How tokens are merged from others, and which may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1 and len(last := self._merge(token, rank)) == 2:
                self.parts[rank] = last
                self.merged[last] = rank

    def _merge(self, token: bytes, below: int) -> tuple[int, ...]:
        own = [token[i : i + 1] for i in range(len(token))]
        while len(own) > 1:
            best, at = below, -1
            for i in range(len(own) - 1):
                r = self.ranks.get(own[i] + own[i + 1], below)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            own[at : at + 2] = [own[at] + own[at + 1]]
        return tuple(self.ranks[x] for x in own)

    def reachable(self, token: int) -> bool:
        """Whether merging can make the token at all."""
        return token in self.parts or len(self.bytes_of[token]) == 1

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging the two tokens' bytes gives these two tokens.

        Undoes the merges of both from the latest back; if at some moment the two that touch could be
        merged earlier than what is undone next, the border would not have stayed.
        """
        merged, parts, a, b = self.merged, self.parts, left, right
        limit = 1 << 60
        while True:
            rank = merged.get((a, b))
            if rank is not None and rank < limit:
                return False
            rank_a, rank_b = (a if a in parts else -1), (b if b in parts else -1)
            if rank_a < 0 and rank_b < 0:
                return True
            if rank_a > rank_b:
                limit, a = rank_a, parts[a][1]  # merges at this rank run left to right, this one before the border's
            else:
                limit, b = rank_b + 1, parts[b][0]


class Table:
    """A map of whole numbers that looks up arrays; what is missing is worked out once and kept up to a limit."""

    def __init__(self, compute: Callable[[int], int], limit: int):
        self.compute, self.limit = compute, limit
        self.clear()

    def clear(self) -> None:
        self._make(1 << 12)

    def _make(self, size: int) -> None:
        self.keys, self.values, self.count = np.full(size, -1, np.int64), np.zeros(size, np.int32), 0
        self.shift = np.uint64(64 - size.bit_length() + 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Where each key stands, or the free place where it would."""
        slots = (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)
        held = self.keys[slots]
        off = np.flatnonzero((held != keys) & (held >= 0))
        while len(off):
            slots[off] = (slots[off] + 1) & (len(self.keys) - 1)
            held = self.keys[slots[off]]
            off = off[(held != keys[off]) & (held >= 0)]
        return slots

    def _add(self, keys: np.ndarray, values: np.ndarray) -> None:
        if self.count + len(keys) > len(self.keys) // 4:
            full = self.keys >= 0
            keys, values = np.concatenate([self.keys[full], keys]), np.concatenate([self.values[full], values])
            self._make(1 << (8 * len(keys)).bit_length())
        self.count += len(keys)
        while len(keys):  # of keys that meet at one free place the last stays; the others look on
            slots = self._slots(keys)
            self.keys[slots], self.values[slots] = keys, values
            lost = self.keys[slots] != keys
            slots = slots[~lost]
            keys, values = keys[lost], values[lost]

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values of the keys, none below 0."""
        slots = self._slots(keys)
        missing = self.keys[slots] < 0
        if missing.any():
            new = np.unique(keys[missing])
            made = np.fromiter(map(self.compute, new.tolist()), np.int32, len(new))
            if self.count + len(new) > self.limit:
                self.clear()
                new = np.unique(keys)
                made = np.fromiter(map(self.compute, new.tolist()), np.int32, len(new))
            self._add(new, made)
            slots = self._slots(keys)
        return self.values[slots]


class Transducer:
    """The determinised encoder of pieces: many short ones at once, or one of any length."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 50_000, window: int = 4096):
        self.merges = Merges(ranks)
        self.ranks, self.max_states, self.window = ranks, max_states, window
        self.lengths = {rank: len(token) for token, rank in ranks.items()}
        #: Tokens that no merge makes stand only for pieces equal to them.
        self.unmade = {token: rank for token, rank in ranks.items() if not self.merges.reachable(rank)}
        self.next_node: list[dict[int, int]] = [{}]
        self.token_at, self.depths = [-1], [0]
        for token, rank in ranks.items():
            node = 0
            for depth, byte in enumerate(token, 1):
                node = self.next_node[node].setdefault(byte, len(self.next_node))
                if node == len(self.token_at):
                    self.next_node.append({})
                    self.token_at.append(-1)
                    self.depths.append(depth)
            if self.merges.reachable(rank):
                self.token_at[node] = rank
        self.pairs = Table(lambda key: self.merges.may_follow(key >> 32, key & 0xFFFFFFFF), 400_000)
        self.moves = Table(lambda key: self._move(key >> 8, key & 255), 1 << 60)
        self.of_length = np.zeros(max(self.lengths, default=0) + 1, np.int64)
        for rank, n in self.lengths.items():
            self.of_length[rank] = n
        self._reset()

    def _reset(self) -> None:
        # a state: the trie nodes of a prefix's suffixes, the longest first
        self.states: list[tuple[int, ...]] = []
        self.index: dict[tuple[int, ...], int] = {}
        self.tokens: list[list[int]] = []  # by state: the tokens that may end here, the longest first
        self.moves.clear()
        self._ending = np.empty((0, 0), np.int64)
        self.start = self._state(())

    def _state(self, nodes: tuple[int, ...]) -> int:
        if nodes not in self.index:
            self.index[nodes] = len(self.states)
            self.states.append(nodes)
            self.tokens.append([t for t in map(self.token_at.__getitem__, nodes) if t >= 0])
        return self.index[nodes]

    def _move(self, state: int, byte: int) -> int:
        """The state after a byte: every open path goes on where the trie does, and a new one begins."""
        children = self.next_node
        nodes = (children[node].get(byte) for node in (*self.states[state], 0))
        return self._state(tuple(n for n in nodes if n is not None))

    def _endings(self) -> np.ndarray:
        """The tokens of all states as a matrix, -1 where a state has no more."""
        if len(self._ending) < len(self.tokens):
            width = max(map(len, self.tokens)) + 1
            made = np.full((len(self.tokens), width), -1, np.int64)
            for i, own in enumerate(self.tokens):
                made[i, : len(own)] = own
            self._ending = made
        return self._ending

    def encode(self, piece: bytes) -> list[int]:
        """The token ids of one piece."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        if len(self.states) > self.max_states:
            self._reset()
        out: list[int] = []
        ends = [-1]  # by place since the last settled one: the last token of the prefix that ends there
        lengths, moves, pairs = self.lengths, {}, {}
        state = self.start
        for byte in piece:
            if (move := moves.get((state, byte))) is None:
                move = moves[state, byte] = self._move(state, byte)
            state = move
            for token in self.tokens[state]:
                left = ends[-lengths[token]]
                if left >= 0:
                    if (fits := pairs.get((left, token))) is None:
                        fits = pairs[left, token] = self.merges.may_follow(left, token)
                    if not fits:
                        continue
                ends.append(token)
                break
            else:
                raise ValueError(f"the vocabulary lacks a byte of {piece[:100]!r}")
            if len(ends) > self.window:
                at = len(ends) - 1
                settled = self._settled(ends, {at, *(at - self.depths[node] for node in self.states[state])})
                out += self._trace(ends, settled)
                del ends[:settled]
                if max(len(moves), len(pairs)) > 100_000:
                    moves.clear()
                    pairs.clear()
        return out + self._trace(ends, len(ends) - 1)

    def _settled(self, ends: list[int], places: set[int]) -> int:
        """Where the token sequences that end at these places last agree."""
        while len(places) > 1:
            places.remove(last := max(places))
            places.add(last - self.lengths[ends[last]])
        return places.pop()

    def _trace(self, ends: list[int], place: int) -> list[int]:
        """The tokens from the last settled place to this one."""
        out = []
        while place > 0:
            out.append(ends[place])
            place -= self.lengths[ends[place]]
        out.reverse()
        return out

    def encode_all(self, offsets: np.ndarray, data: np.ndarray, longest: int = 64, block: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many pieces, none empty, on end, and where each piece's ids begin and end in them.

        Pieces are bytes on end with their offsets. Short ones run side by side, a byte of each at a time,
        in blocks of like length.
        """
        sizes = np.diff(offsets)
        order = np.argsort(-sizes, kind="stable")
        n_long = int(np.searchsorted(-sizes[order], -longest, side="left"))
        rows, tokens, back = [], [], []
        for row in order[:n_long].tolist():
            own = self.encode(data[offsets[row] : offsets[row + 1]].tobytes())
            rows.append(np.full(len(own), row))
            tokens.append(np.array(own, np.int64))
            back.append(np.arange(len(own) - 1, -1, -1))
        for at in range(n_long, len(order), block):
            if len(self.states) > self.max_states:
                self._reset()
            part = order[at : at + block]
            ends = self._run(offsets[part], sizes[part], data)
            place, who, turn = sizes[part].copy(), np.arange(len(part)), 0
            while len(who):
                own = ends[place[who], who]
                rows.append(part[who])
                tokens.append(own)
                back.append(np.full(len(who), turn))
                place[who] -= self.of_length[own]
                who, turn = who[place[who] > 0], turn + 1
        if not rows:
            return np.empty(0, np.uint32), np.zeros(1, np.int64)
        row, token, from_end = map(np.concatenate, (rows, tokens, back))
        if self.unmade:
            row, token, from_end = self._put_unmade(offsets, data, row, token, from_end)
        bounds = np.append(0, np.cumsum(np.bincount(row, minlength=len(sizes))))
        ids = np.empty(len(row), np.uint32)
        ids[bounds[row + 1] - 1 - from_end] = token
        return ids, bounds

    def _run(self, starts: np.ndarray, sizes: np.ndarray, data: np.ndarray) -> np.ndarray:
        """By place and piece (the longest first): the last token of the piece's prefix that ends there."""
        ends = np.full((int(sizes[0]) + 1, len(sizes)), -1, np.int64)
        state = np.full(len(sizes), self.start, np.int64)
        for place in range(1, len(ends)):
            n = int(np.searchsorted(-sizes, -place, side="right"))  # pieces this long
            state = self.moves.get(state[:n] << 8 | data[starts[:n] + (place - 1)]).astype(np.int64)
            ending, turn, who = self._endings(), 0, np.arange(n)
            while len(who):
                token = ending[state[who], turn]
                if (token < 0).any():
                    raise ValueError("the vocabulary lacks a byte")
                left = ends[place - self.of_length[token], who]
                fits = left < 0
                check = np.flatnonzero(~fits)
                if len(check):
                    fits[check] = self.pairs.get(left[check] << 32 | token[check]) > 0
                ends[place, who[fits]] = token[fits]
                who, turn = who[~fits], turn + 1
        return ends

    def _put_unmade(self, offsets: np.ndarray, data: np.ndarray, row: np.ndarray, token: np.ndarray, from_end: np.ndarray) -> tuple[np.ndarray, ...]:
        """Tokens that no merge makes in place of what the pieces equal to them were split into."""
        sizes = np.diff(offsets)
        likely = np.flatnonzero(np.isin(sizes, list(set(map(len, self.unmade))))).tolist()
        found = {i: self.unmade[own] for i in likely if (own := data[offsets[i] : offsets[i + 1]].tobytes()) in self.unmade}
        other = ~np.isin(row, list(found))
        return np.append(row[other], list(found)).astype(np.int64), np.append(token[other], list(found.values())).astype(np.int64), np.append(from_end[other], [0] * len(found)).astype(np.int64)


def _buffers(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an array without nulls."""
    strings = strings.cast(pa.large_binary())
    if strings.offset:
        strings = pa.concat_arrays([strings, strings[:0]])
    offsets = np.asarray(pa.Array.from_buffers(pa.int64(), len(strings) + 1, [None, strings.buffers()[1]], offset=strings.offset))
    return offsets, np.frombuffer(strings.buffers()[2] or b"", np.uint8)


class Tokenizer:
    """Encodes texts and decodes ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = Transducer(ranks)
        self.pattern, self.spaced = regex.compile(pattern), pattern == SPACED_PATTERN
        self.token_bytes = {i: t for t, i in ranks.items()}
        table = [self.token_bytes.get(i) for i in range(max(self.token_bytes, default=-1) + 1)]
        self._table = pa.array(table, pa.large_binary())
        #: By id: whether the token is whole characters, so that none is open after it.
        self.whole = np.array([t is not None and _is_text(t) for t in table], bool)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return self.encode_all(pa.array([text], pa.string()))[0].as_py()

    def encode_all(self, texts: pa.Array) -> pa.BinaryArray:
        """Packed ids of each text of a string array.

        Each distinct chunk is cut into pieces once, each distinct piece encoded once; Arrow strings
        the ids of all chunks together.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            return pa.array([], pa.binary())
        chunks, order, bounds = self._cut(texts)
        pieces, of_chunk = self._split(chunks)
        ids, ends = self.transducer.encode_all(*_buffers(pieces))
        packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(pieces), [None, pa.py_buffer(ends * 4), pa.py_buffer(ids.astype("<u4"))])
        lists = of_chunk.take(pa.array(order))
        joined = packed.take(lists.flatten())
        places, _ = _buffers(joined)
        of_text = places[np.asarray(lists.offsets)[bounds]]
        return pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(of_text.astype(np.int32)), joined.buffers()[2] or pa.py_buffer(b"")])

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct chunks, the chunks of all texts by row of these, and where each text's chunks begin and end."""
        if not self.spaced:
            return texts, np.arange(len(texts)), np.arange(len(texts) + 1)
        parts = pc.split_pattern(texts, " ")
        bounds = np.asarray(parts.offsets).astype(np.int64)
        found = parts.flatten().dictionary_encode()
        codes, words = np.asarray(found.indices).astype(np.int64), found.dictionary
        first = np.zeros(len(codes), bool)
        first[bounds[:-1]] = True
        begins = first | pc.match_substring_regex(words, _VISIBLE).to_numpy(zero_copy_only=False)[codes]
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(codes))
        keys, long = codes[starts] * 2 + first[starts], ends - starts > 1
        wanted = np.zeros(2 * len(words), bool)
        wanted[keys[~long]] = True
        wanted = np.flatnonzero(wanted)
        rows = np.zeros(2 * len(words), np.int64)
        rows[wanted] = np.arange(len(wanted))
        spaces = pa.array([" ", ""], pa.large_string()).take(pa.array(wanted & 1))
        chunks = pc.binary_join_element_wise(spaces, words.take(pa.array(wanted >> 1)), pa.scalar("", pa.large_string()))
        order, more = rows[keys], []
        for k in np.flatnonzero(long).tolist():  # no visible character follows the spaces in these
            order[k] = len(chunks) + len(more)
            more.append(("" if first[starts[k]] else " ") + " ".join(words.take(pa.array(codes[starts[k] : ends[k]])).to_pylist()))
        return pa.concat_arrays([chunks, pa.array(more, pa.large_string())]), order, np.searchsorted(starts, bounds)

    def _split(self, chunks: pa.Array) -> tuple[pa.Array, pa.LargeListArray]:
        """Distinct pieces, and by chunk its pieces as rows of these."""
        words = pc.match_substring_regex(chunks, _WORDS).to_numpy(zero_copy_only=False) if self.spaced else np.zeros(len(chunks), bool)
        own = [self.pattern.findall(c) for c in chunks.filter(pa.array(~words)).to_pylist()]
        counts = np.ones(len(chunks), np.int64)
        counts[~words] = np.fromiter(map(len, own), np.int64, len(own))
        found = pa.concat_arrays([chunks.filter(pa.array(words)), pa.array([p for c in own for p in c], pa.large_string())]).dictionary_encode()
        codes = np.asarray(found.indices)
        bounds = np.append(0, np.cumsum(counts))
        alone = np.zeros(len(codes), bool)
        alone[bounds[:-1][words]] = True
        placed = np.empty(len(codes), np.int32)
        placed[alone], placed[~alone] = codes[: int(words.sum())], codes[int(words.sum()) :]
        return found.dictionary, pa.LargeListArray.from_arrays(pa.array(bounds), pa.array(placed))

    def gather(self, ids: np.ndarray) -> tuple[np.ndarray, memoryview]:
        """The bytes of the ids on end, and where each begins and ends in them; unknown ids raise."""
        found = self._table.take(pa.array(ids))
        if found.null_count:
            raise KeyError("an id is unknown")
        offsets, data = _buffers(found)
        return offsets, memoryview(data)

    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes of the ids."""
        return b"".join(map(self.token_bytes.__getitem__, ids))


def _is_text(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


# Well-formed UTF-8 by the Unicode standard. By lead byte range: the range of the second byte, and bytes in all.
_LEADS = [
    (0xC2, 0xDF, 0x80, 0xBF, 2),
    (0xE0, 0xE0, 0xA0, 0xBF, 3),
    (0xE1, 0xEC, 0x80, 0xBF, 3),
    (0xED, 0xED, 0x80, 0x9F, 3),
    (0xEE, 0xEF, 0x80, 0xBF, 3),
    (0xF0, 0xF0, 0x90, 0xBF, 4),
    (0xF1, 0xF3, 0x80, 0xBF, 4),
    (0xF4, 0xF4, 0x80, 0x8F, 4),
]
# Fixed values end.


class Utf8Machine:
    """The states between the bytes of a character: which byte may follow, and how many are still to come.

    State 0 is between characters. A byte that cannot follow ends what was open as malformed and is read
    anew from state 0; a byte that begins nothing leaves the machine there.
    """

    def __init__(self):
        #: By state: the lowest and the highest byte that may follow, and the state after it.
        self.rules: list[tuple[int, int, int]] = [(1, 0, 0), (0x80, 0xBF, 0), (0x80, 0xBF, 1)]
        self.lead = [0] * 256
        for low, high, second_low, second_high, size in _LEADS:
            self.rules.append((second_low, second_high, size - 2))
            self.lead[low : high + 1] = [len(self.rules) - 1] * (high + 1 - low)

    def step(self, state: int, byte: int) -> tuple[int, bool]:
        """The state after a byte, and whether the byte belongs to the character open before it."""
        low, high, after = self.rules[state]
        return (after, True) if low <= byte <= high else (self.lead[byte], False)


_UTF8 = Utf8Machine()


class StreamDecoder:
    """Turns ids that arrive bit by bit into text, never cutting a character.

    What is kept between ids is the machine's state and the bytes of the character that it is in, three
    at most. Bytes that are not UTF-8 become U+FFFD as Python's replace handler has it.
    """

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer, self.state, self.waiting = tokenizer, 0, b""

    def feed_bytes(self, ids: np.ndarray | list[int], data: bytes | memoryview | None = None, lengths: np.ndarray | None = None) -> bytes:
        """The bytes of the characters that these ids complete; ``data`` and ``lengths`` of the ids may be given."""
        if data is None:
            offsets, data = self.tokenizer.gather(np.asarray(ids, np.int64))
            lengths = np.diff(offsets)
        if not len(ids):
            return b""
        whole, at, back = self.tokenizer.whole, len(ids), 0
        while at and not whole[ids[at - 1]]:
            at -= 1
            back += int(lengths[at])
        # after a token of whole characters the machine is in state 0, whatever was open before it
        state, opened = (0, 0) if at else (self.state, len(self.waiting))
        for byte in data[len(data) - back :]:
            state, goes_on = _UTF8.step(state, byte)
            opened = opened + 1 if goes_on and state else int(state > 0)
        everything = self.waiting + bytes(data) if self.waiting else bytes(data)
        cut = len(everything) - opened
        self.state, self.waiting = state, everything[cut:]
        return everything[:cut]

    def feed(self, ids: np.ndarray | list[int]) -> str:
        """The characters that these ids complete."""
        return self.feed_bytes(ids).decode("utf-8", "replace")

    def finish_bytes(self) -> bytes:
        """The bytes left at the end of the stream."""
        data, self.state, self.waiting = self.waiting, 0, b""
        return data

    def finish(self) -> str:
        """The characters left at the end of the stream."""
        return self.finish_bytes().decode("utf-8", "replace")


def streams(tokenizer: Tokenizer, packed: pa.Array, stride: int) -> Iterator[Iterator[bytes]]:
    """For each row of packed ids its bytes, ``stride`` ids at a time, characters whole."""
    ends, ids = _buffers(packed)
    ends, ids = ends // 4, ids[ends[0] : ends[-1]].view("<u4")
    offsets, data = tokenizer.gather(ids)
    lengths = np.diff(offsets)
    ends = (ends - ends[0]).tolist()

    def stream(at: int, end: int) -> Iterator[bytes]:
        decoder = StreamDecoder(tokenizer)
        for k in range(at, end, stride):
            stop = min(k + stride, end)
            yield decoder.feed_bytes(ids[k:stop], data[offsets[k] : offsets[stop]], lengths[k:stop])
        yield decoder.finish_bytes()

    return (stream(a, b) for a, b in zip(ends, ends[1:], strict=False))


_LOADED: dict[tuple[str, str], Tokenizer] = keeps()


def load(path: str, pattern: str) -> Tokenizer:
    """The tokenizer of a rank file, kept in this process."""
    if (path, pattern) not in _LOADED:
        only(_LOADED)
        _LOADED[path, pattern] = Tokenizer(read_ranks(path), pattern)
    return _LOADED[path, pattern]


def _n_tokens(packed: pa.Array) -> pa.Array:
    return pc.divide(pc.cast(pc.coalesce(pc.binary_length(packed), 0), pa.int64()), 4)


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with tokens (binary, little-endian unsigned 32-bit ids) and n_tokens.

    The rank file must lie at ``path`` on every machine.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        tokenizer = load(path, pattern)
        for batch in batches:
            for part in pieces(batch, text_col, 6 << 20):
                made = tokenizer.encode_all(part.column(text_col))
                yield part, {"tokens": made, "n_tokens": _n_tokens(made)}

    return with_columns(docs, [("tokens", "binary"), ("n_tokens", "long")], run)


def decode(docs: DataFrame, path: str, pattern: str, tokens_col: str = "tokens", stride: int = 256) -> DataFrame:
    """Adds decoded (the text, decoded as a stream of ``stride`` ids at a time) and decoded_sha256 (of the bytes)."""

    def run(batches: Iterator[pa.RecordBatch]):
        tokenizer = load(path, pattern)
        for batch in batches:
            for part in pieces(batch, tokens_col):
                texts, digests = [], []
                for stream in streams(tokenizer, pc.fill_null(part.column(tokens_col), b""), stride):
                    own, digest = [], hashlib.sha256()
                    for data in stream:
                        own.append(data)
                        digest.update(data)
                    texts.append(b"".join(own).decode("utf-8", "replace"))
                    digests.append(digest.hexdigest())
                yield part, {"decoded": texts, "decoded_sha256": digests}

    return with_columns(docs, [("decoded", "string"), ("decoded_sha256", "string")], run)


def round_trip(docs: DataFrame, path: str, pattern: str, text_col: str = "text", stride: int = 256) -> DataFrame:
    """Replaces the text by tokens (binary), n_tokens, ids_sha256 and decoded_sha256, in one pass."""

    def digest(stream: Iterator[bytes]) -> str:
        own = hashlib.sha256()
        for data in stream:
            own.update(data)
        return own.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]):
        tokenizer = load(path, pattern)
        for batch in batches:
            for part in pieces(batch, text_col, 6 << 20):
                made = tokenizer.encode_all(part.column(text_col))
                back = [digest(x) for x in streams(tokenizer, made, stride)]
                ids = [hashlib.sha256(x.as_buffer()).hexdigest() for x in made]
                yield part, {text_col: pa.nulls(len(made), pa.string()), "tokens": made, "n_tokens": _n_tokens(made), "ids_sha256": ids, "decoded_sha256": back}

    added = [(text_col, "string"), ("tokens", "binary"), ("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    return with_columns(docs, added, lean(run, alone=False)).drop(text_col)


def op8_bpe(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Digests of every document's token ids and of what they decode to."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return round_trip(docs, public_tokenizers.path(vocabulary), public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
