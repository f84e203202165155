"""Byte-level BPE as a lazily determinised finite-state transducer.

The merges are compiled into two facts: the trie of tokens, and which token may
follow which (a pair is allowed if the merges leave it as it is).  A prefix of a
piece then has exactly one last token that fits.  The transducer reads a piece
byte by byte; the tokens under way at a byte are the trie nodes that a suffix of
the bytes read reaches, and its state, named by the longest of them, stands for
them all.  A state's moves, and the tokens that may end there, are made when
first met; there are no more states than trie nodes.  At each byte the longest
token that ends there and fits behind its own predecessor is the prefix's last.
Tokens are emitted once all tokens under way agree on what stands before them,
or at the piece's end.

Whether a pair fits is read from the merges' own order.  Along the right edge of
the first token stand its successive last parts, along the left edge of the
second its first parts; a part lives from its own merge to that of the next.
The pair fits if no two parts that live at the same time merge with each other
before either goes into its next part.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from stagecraft.llm import common as C

#: Pieces kept per worker, in each of two generations.
CACHE = 1 << 18
#: Token pairs whose fit is remembered.
PAIRS = 1 << 18
#: Positions that may wait before agreed tokens are emitted.
LOOKAHEAD = 1 << 10
_NEVER = 1 << 60


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.length = {i: len(t) for t, i in ranks.items()}
        self.shown = {i: str(i) for i in self.token}
        self.moves: dict[int, int] = {}  # (state << 8 | byte) -> state; the trie's own moves first
        self.above, self.byte, self.depth = array("i", [0]), bytearray(1), array("H", [0])
        self.whole: dict[int, int] = {}  # node -> token
        for t, i in ranks.items():
            node = 0
            for b in t:
                key = node << 8 | b
                nxt = self.moves.get(key)
                if nxt is None:
                    nxt = self.moves[key] = len(self.depth)
                    self.above.append(node)
                    self.byte.append(b)
                    self.depth.append(self.depth[node] + 1)
                node = nxt
            self.whole[node] = i
        self.shorter = array("i", [-1]) * len(self.depth)  # the next longest node under way, when known
        self.steps: dict[int, tuple] = {}  # (state << 8 | byte) -> (next state << 8, tokens that end there), as met
        self._ends: dict[int, tuple] = {}
        self._edges: dict[int, tuple | None] = {}
        self._fits: dict[int, dict[int, bool]] = {}  # token -> {token before it: whether it fits}
        self._pairs = 0
        self._pieces: dict[str, tuple] = {}
        self._older: dict[str, tuple] = {}

    # -- the automaton ---------------------------------------------------------
    def _shorter(self, node: int) -> int:
        """The longest other trie node that the bytes up to ``node`` end in."""
        path = []
        while self.shorter[node] < 0 and self.depth[node] > 1:
            path.append(node)
            node = self.above[node]
        for n in reversed(path):
            self.shorter[n] = self._move(self._shorter(self.above[n]), self.byte[n])
            node = n
        return self.shorter[node] if self.depth[node] > 1 else 0

    def _move(self, state: int, byte: int) -> int:
        """The state after one more byte; kept."""
        key, asked = state << 8 | byte, []
        nxt = self.moves.get(key)
        while nxt is None:
            asked.append(key)
            if not state:
                nxt = 0
                break
            state = self._shorter(state)
            key = state << 8 | byte
            nxt = self.moves.get(key)
        for key in asked:
            self.moves[key] = nxt
        return nxt

    def _step(self, key: int) -> tuple:
        """The next state (times 256), and the tokens made by merges that end there,
        longest first, as (length, token, whether it fits behind another); kept."""
        state = self._move(key >> 8, key & 255)
        ends = self._ends.get(state)
        if ends is None:
            out, node = [], state
            while node:
                t = self.whole.get(node)
                if t is not None and self.edges(t) is not None:
                    out.append((self.length[t], t, self._fits.setdefault(t, {})))
                node = self._shorter(node)
            ends = self._ends[state] = tuple(out)
        self.steps[key] = got = (state << 8, ends)
        return got

    # -- the merges ------------------------------------------------------------
    def merged(self, data: bytes, least: int = 1) -> list[bytes]:
        """The merges themselves, down to ``least`` parts."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > least:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1))
            if rank == _NEVER:
                break
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def edges(self, token: int) -> tuple | None:
        """((first parts, ranks), (last parts, ranks)) from the byte up to the token;
        None if merges do not make it.  Ranks are the part's own, and one of
        ``_NEVER`` behind the token's."""
        if token in self._edges:
            return self._edges[token]
        data = self.token[token]
        parts = [data] if len(data) == 1 else self.merged(data, 2)
        if len(parts) == 1:
            got = (((data,), (token, _NEVER)),) * 2
        elif len(parts) == 2 and parts[0] + parts[1] == data:
            left, right = self.edges(self.ranks[parts[0]]), self.edges(self.ranks[parts[1]])
            got = tuple((own[0] + (data,), own[1][:-1] + (token, _NEVER)) for own in (left[0], right[1]))
        else:
            got = None
        self._edges[token] = got
        return got

    def fits(self, before: int, token: int) -> bool:
        """Whether merges leave the two tokens side by side."""
        first, last = self.edges(token)[0], self.edges(before)[1]
        (right, ends), (left, starts) = last, first
        ranks, i, j = self.ranks, 0, 0
        while True:
            both = ranks.get(right[i] + left[j], _NEVER)
            up_right, up_left = ends[i + 1], starts[j + 1]
            if up_right <= up_left:  # equal ranks merge from the left
                if both < up_right:
                    return False
                if up_right == _NEVER:
                    return True
                i += 1
            else:
                if both <= up_left:
                    return False
                j += 1

    def _learn(self, before: int, token: int) -> bool:
        if self._pairs >= PAIRS:
            for own in self._fits.values():
                own.clear()
            self._pairs = 0
        self._pairs += 1
        ok = self._fits[token][before] = self.fits(before, token)
        return ok

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        if len(data) < LOOKAHEAD:
            return self._encode_short(data)
        steps, out = self.steps, []
        state, done, last = 0, 0, []  # last[i]: last token of data[:done + i + 1]
        at = 0  # len(last)
        for b in data:
            got = steps.get(state | b)
            state, options = self._step(state | b) if got is None else got
            for n, t, known in options:
                if n <= at:
                    before = last[at - n]
                elif n > at + 1:  # reaches behind what is settled
                    continue
                elif done:
                    before = out[-1]
                else:  # the prefix is one token
                    break
                ok = known.get(before)
                if ok or ok is None and self._learn(before, t):
                    break
            last.append(t)
            at += 1
            if at >= LOOKAHEAD and at % LOOKAHEAD == 0:
                agreed = self._agreed(state >> 8, done + at, done, last)
                out += self._back(agreed, done, last)
                del last[:agreed - done]
                done = agreed
                at = len(last)
        return out + self._back(len(data), done, last)

    def _encode_short(self, data: bytes) -> list[int]:
        """A piece that ends before anything has to be emitted: the states are read
        byte by byte, and last tokens are settled only where the end builds on them."""
        steps, ends, state = self.steps, [()], 0
        for b in data:
            got = steps.get(state | b)
            state, options = self._step(state | b) if got is None else got
            ends.append(options)
        last: list[int | None] = [None] * len(ends)
        asked = [len(data)]
        while asked:
            at = asked[-1]
            for n, t, known in ends[at]:
                if n != at:  # else the prefix is one token
                    before = last[at - n]
                    if before is None:
                        asked.append(at - n)
                        break
                    ok = known.get(before)
                    if not ok and (ok is not None or not self._learn(before, t)):
                        continue
                last[at] = t
                asked.pop()
                break
        tokens, end = [], len(data)
        while end:
            t = last[end]
            tokens.append(t)
            end -= self.length[t]
        return tokens[::-1]

    def _back(self, end: int, done: int, last: list[int]) -> list[int]:
        tokens = []
        while end > done:
            t = last[end - done - 1]
            tokens.append(t)
            end -= self.length[t]
        return tokens[::-1]

    def _agreed(self, state: int, at: int, done: int, last: list[int]) -> int:
        """The furthest token end that every token under way builds on."""
        starts, node = [], state
        while node:
            starts.append(max(done, at - self.depth[node]))
            node = self._shorter(node)
        starts.append(at)
        chain, p = [], starts[0]
        while p > done:
            chain.append(p)
            p -= self.length[last[p - done - 1]]
        chain.append(done)
        common = set(chain)
        limit = starts[0]
        for p in starts[1:]:
            while p not in common:
                p -= self.length[last[p - done - 1]]
            limit = min(limit, p)
        return max(limit, done)

    def piece(self, text: str) -> tuple[int, str, bytes]:
        """(tokens, their decimal ids joined by blanks, the bytes decoded from the ids)."""
        got = self._pieces.get(text)
        if got is not None:
            return got
        got = self._older.get(text)
        if got is None:
            ids = self.encode_piece(text.encode("utf-8"))
            got = (len(ids), " ".join(map(self.shown.__getitem__, ids)), b"".join(map(self.token.__getitem__, ids)))
        if len(text) <= 64:
            if len(self._pieces) >= CACHE:
                self._older, self._pieces = self._pieces, {}
            self._pieces[text] = got
        return got

    def decode(self, ids) -> str:
        """Text of the ids; bytes that are no UTF-8 become U+FFFD."""
        stream = Utf8Stream()
        ids = list(ids)
        out = [stream.feed(b"".join(map(self.token.__getitem__, ids[i:i + 65536]))) for i in range(0, len(ids), 65536)]
        return "".join(out) + stream.close()


class Utf8Stream:
    """Incremental UTF-8 state machine: the state is the unfinished tail of a
    character (up to three bytes) that waits for its continuation bytes."""

    def __init__(self):
        self.tail = b""

    @staticmethod
    def _wanted(lead: int) -> int:
        return 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4 if lead < 0xF5 else 1

    def feed(self, data: bytes) -> str:
        data = self.tail + data
        end = len(data)
        for back in range(1, min(3, end) + 1):
            lead = data[end - back]
            if lead & 0xC0 != 0x80:  # the start of the last character
                if self._wanted(lead) > back:
                    end -= back
                break
        self.tail = data[end:]
        return data[:end].decode("utf-8", "replace")

    def close(self) -> str:
        out, self.tail = self.tail.decode("utf-8", "replace"), b""
        return out


def transducer(path: str) -> Transducer:
    """One per worker and vocabulary, so its tables are reused."""
    return C.held(path, lambda: Transducer(load_ranks(path)))


def _digest(path: str, pattern: str):
    names = ["doc", "n_tokens", "ids_sha256", "decoded_sha256"]
    schema = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.string(), pa.string()])))

    def run(batches):
        t, split = transducer(path), regex.compile(pattern)
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text")):
                n, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()
                stream, gap = Utf8Stream(), ""
                for pieces in _pieces(t, split, text.as_py() or ""):
                    counts, ids, decoded = zip(*pieces)
                    n += sum(counts)
                    ids_hash.update((gap + " ".join(ids)).encode())
                    gap = " "
                    text_hash.update(stream.feed(b"".join(decoded)).encode())
                text_hash.update(stream.close().encode())
                for r, v in zip(rows, (doc, n, ids_hash.hexdigest(), text_hash.hexdigest())):
                    r.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(r, f.type) for r, f in zip(rows, schema)], schema=schema)

    return run


def _pieces(t: Transducer, split, text: str, limit: int = 1 << 17):
    """``Transducer.piece`` of the text's pieces, about ``limit`` at a time."""
    pieces = split.findall(text) if len(text) < 8 * limit else (m.group() for m in split.finditer(text))
    parts = [pieces] if isinstance(pieces, list) and len(pieces) <= limit else iter(lambda own=iter(pieces): list(islice(own, limit)), [])
    for part in parts:
        out = list(map(t._pieces.get, part))
        if None in out:
            out = [t.piece(p) if got is None else got for p, got in zip(part, out)]
        if out:
            yield out


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, SHA-256 of the decimal ids joined by one space,
    SHA-256 of the bytes decoded from the ids.  Null text is empty (no tokens).
    ``path`` names the rank file on every worker; it is never copied."""
    out = C.keyed(docs, id_col, text_col).mapInArrow(_digest(path, pattern), "doc long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.select(C.original_id(), "n_tokens", "ids_sha256", "decoded_sha256")


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>), one row per row of ``docs``."""
    schema = pa.schema([("doc", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        t, split = transducer(path), regex.compile(pattern)
        for batch in batches:
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text")):
                ids = [int(i) for part in _pieces(t, split, text.as_py() or "") for _, own, _ in part for i in own.split()]
                yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([ids], pa.list_(pa.int32()))], schema=schema)

    return C.keyed(docs, id_col, text_col).mapInArrow(run, "doc long, ids array<int>").select(C.original_id(), "ids")
