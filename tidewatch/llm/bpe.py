"""Byte-pair merges compiled into a deterministic automaton by successive merge gadgets.

The automaton reads tokens. It starts as one state with a loop for every base symbol. Each merge ``(a, b) -> c``, in rank
order, applies the merge gadget: every state with an ``a`` arc into a state with a ``b`` arc gets a ``c`` arc to the place that
``a b`` led to, and the ``a`` arcs are redirected to a copy of their target without the ``b`` arc. So all arcs of one token
lead to one state, kept in ``target``; a copy is made only while other tokens share the old one. When all merges are done, a token sequence
is a path of the automaton exactly when it is the encoding of the string it spells, and each string has one such path.

The arcs are a table of bits, one row per state and one column per token, laid out in blocks of 64 tokens: a gadget copies a row by one word of each block, and
a column inside two blocks. A vocabulary of 50,000 tokens has some 15,000 states and a table of 100 MB, compiled in a few
seconds, once per worker.

Words are encoded by tables alone: from each state on the path so far, a trie is walked symbol by symbol (``trie[node, symbol]``); where it spells a
token whose arc the state has, the path goes on to that place and to ``target[token]``. Prefixes have one path each, so nothing is searched and nothing taken back.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import cached_property

import numpy as np

U = np.uint64
ONE, BASE = U(1), U(0x9E3779B97F4A7C15)
MIX1, MIX2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
#: Words longer than this many symbols take the one-word path.
WIDE = 40


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser on uint64."""
    x = x ^ (x >> U(30))
    x = x * MIX1
    x = x ^ (x >> U(27))
    x = x * MIX2
    return x ^ (x >> U(31))


class Lookup:
    """int64 values under uint64 keys, found for whole arrays at once; -1 where absent."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(12, int(len(keys) * 8).bit_length())
        n = 1 << self.bits
        self.keys, self.values = np.zeros(n, U), np.full(n, -1, np.int64)
        slots = self._slot(keys)
        left = np.arange(len(keys))
        self.probes = 0
        while len(left):
            self.probes += 1
            at = slots[left]
            free = self.values[at] < 0
            _, first = np.unique(at, return_index=True)
            won = np.zeros(len(left), bool)
            won[first] = True
            won &= free
            self.keys[at[won]] = keys[left[won]]
            self.values[at[won]] = values[left[won]]
            left = left[~won]
            slots[left] = (slots[left] + 1) & (n - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * BASE) >> U(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        out = np.where(self.keys[at] == keys, self.values[at], -1)
        for k in range(1, self.probes):
            nxt = (at + k) & ((1 << self.bits) - 1)
            out = np.where((out < 0) & (self.keys[nxt] == keys), self.values[nxt], out)
        return out


class MergeAutomaton:
    """tokens: each token's base symbols (tuple of ints). merges: (left, right, result) ids in rank order; of merges with one result only one can apply."""

    def __init__(self, tokens: dict[int, tuple[int, ...]], merges: list[tuple[int, int, int]]):
        self.unknown = max(tokens) + 1
        self._compile(tokens, merges)
        self._spell(tokens)

    def _compile(self, tokens: dict[int, tuple[int, ...]], merges: list[tuple[int, int, int]]) -> None:
        """Apply the gadget of each merge. Columns are numbered as tokens come to be."""
        made = {c for _, _, c in merges}
        order = [t for t in tokens if t not in made]
        column = np.full(self.unknown + 1, -1)
        column[order] = np.arange(len(order))
        blocks, room = (len(tokens) + 64) // 64, 256
        arcs = np.zeros((blocks, room), U)
        for k in range(len(order)):
            arcs[k >> 6, 0] |= ONE << U(k & 63)
        target = [-1] * (self.unknown + 1)
        for t in order:
            target[t] = 0
        shared, live = [len(order)] + [0] * (room - 1), 1
        done = len(order)
        column_of = column.tolist()
        for a, b, c in merges:
            p, cb, ca = target[a], column_of[b], column_of[a]
            if p < 0 or cb < 0 or target[c] >= 0 or not int(arcs[cb >> 6, p]) >> (cb & 63) & 1:
                continue  # a and b never meet: an earlier merge took one of them, or both
            target[c] = target[b]
            shared[target[b]] += 1
            if shared[p] > 1:  # others lead there too: a copy for a alone
                if live == room:
                    arcs, room = np.concatenate([arcs, np.zeros_like(arcs)], axis=1), 2 * room
                    shared += [0] * live
                arcs[:, live] = arcs[:, p]
                shared[p] -= 1
                shared[live] = 1
                target[a] = p = live
                live += 1
            arcs[cb >> 6, p] &= ~(ONE << U(cb & 63))
            arcs[done >> 6, :live] |= ((arcs[ca >> 6, :live] >> U(ca & 63)) & ONE) << U(done & 63)
            column_of[c] = done
            done += 1
        # the start, and what follows a symbol outside the vocabulary: a state with every arc
        self.start, column_of[self.unknown] = live, done
        self.arcs = np.full((blocks, live + 1), ~U(0))
        self.arcs[:, :live] = arcs[:, :live]
        self.arcs[done >> 6] |= ONE << U(done & 63)
        target[self.unknown] = self.start
        self.target, self.column = np.array(target), np.array(column_of)
        self._targets, self._columns = target, column_of

    def _spell(self, tokens: dict[int, tuple[int, ...]]) -> None:
        """The trie of all tokens that have arcs: next node by node and symbol, and the token that a node spells."""
        self.sigma = max(max(s) for s in tokens.values()) + 2
        self.children: dict[int, int] = {}
        accept, children, sigma = [-1], self.children, self.sigma
        for t, symbols in tokens.items():
            if self._targets[t] < 0:
                continue
            node = 0
            for x in symbols:
                key = node * sigma + x
                node = children.get(key)  # type: ignore[assignment]
                if node is None:
                    node = children[key] = len(accept)
                    accept.append(-1)
            accept[node] = t
        self.longest = max(map(len, tokens.values()))
        self._accept, self.accept = accept, np.array(accept)
        self.trie = Lookup(np.fromiter(children.keys(), U, len(children)), np.fromiter(children.values(), np.int64, len(children)))

    def has_arc(self, state: int, token: int) -> bool:
        c = self._columns[token]
        return bool(int(self.arcs[c >> 6, state]) >> (c & 63) & 1)

    def paths(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For words of one length (rows of symbols): at each end position the last token of the prefix's path, and that token's length."""
        m, n = symbols.shape
        symbols = np.minimum(symbols, self.sigma - 1).astype(U)
        # where no token ends the path, the symbol is unknown to the vocabulary
        last, size = np.full((m, n + 1), self.unknown, np.int64), np.ones((m, n + 1), np.int64)
        every, sigma = np.arange(m), U(self.sigma)
        for j in range(n):
            rows, node = every, np.zeros(m, U)
            state = self.target[last[:, j]] if j else np.full(m, self.start)
            for i in range(j, min(n, j + self.longest)):
                node = self.trie.get(node * sigma + symbols[rows, i])
                on = np.flatnonzero(node >= 0)
                if not len(on):
                    break
                if len(on) < len(rows):
                    rows, node = rows[on], node[on]
                token = self.accept[node]
                column = self.column[token]
                taken = (token >= 0) & ((self.arcs[column >> 6, state[rows]] >> (column & 63).astype(U)) & ONE).astype(bool)
                at = rows[taken]
                last[at, i + 1], size[at, i + 1] = token[taken], i + 1 - j
                node = node.astype(U)
        return last, size

    def path(self, symbols: list[int]) -> tuple[list[int], list[int]]:
        """The same for one word of any length, in time linear in it."""
        n = len(symbols)
        last, size = [self.unknown] * (n + 1), [1] * (n + 1)
        children, accept, sigma = self.children, self._accept, self.sigma
        for j in range(n):
            state, node = self._targets[last[j]] if j else self.start, 0
            for i in range(j, min(n, j + self.longest)):
                node = children.get(node * sigma + symbols[i], -1) if symbols[i] < sigma else -1
                if node < 0:
                    break
                t = accept[node]
                if t >= 0 and self.has_arc(state, t):
                    last[i + 1], size[i + 1] = t, i + 1 - j
        return last, size

    def encode(self, words: list[np.ndarray]) -> list[list[int]]:
        """Ids of each word, given as arrays of base symbols."""
        out: list[list[int]] = [[] for _ in words]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(sizes):
            rows = np.flatnonzero(sizes == n)
            if n == 0:
                continue
            if n > WIDE:
                for r in rows:
                    last, size = self.path(words[r].tolist())
                    i, ids = int(n), []
                    while i:
                        ids.append(last[i])
                        i -= size[i]
                    out[r] = ids[::-1]
                continue
            last, size = self.paths(np.stack([words[r] for r in rows]))
            at, live = np.full(len(rows), n), np.arange(len(rows))
            steps = []
            while len(live):
                step = np.full(len(rows), -1, np.int64)
                step[live] = last[live, at[live]]
                steps.append(step)
                at[live] -= size[live, at[live]]
                live = live[at[live] > 0]
            for r, ids in zip(rows, np.stack(steps[::-1], 1).tolist(), strict=True):
                out[r] = [x for x in ids if x >= 0]
        return out


def byte_symbols() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteVocabulary:
    """A byte-level BPE file: its automaton, its arc labels as bytes, its added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf8") as f:
            spec = json.load(f)
        chars = byte_symbols()
        vocab = spec["model"]["vocab"]
        self.label = {t: bytes(chars[c] for c in s) for s, t in vocab.items()}
        self._vocab, self._merges = vocab, spec["model"]["merges"]
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.label |= {t: s.encode() for s, t in self.added.items()}

    @cached_property
    def automaton(self) -> MergeAutomaton:
        """Compiled when first asked for: not every user of the labels encodes by it."""
        vocab, merges = self._vocab, []
        for pair in self._merges:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            merges.append((vocab[a], vocab[b], vocab[a + b]))
        return MergeAutomaton({t: tuple(s) for t, s in self.label.items() if t not in self.added.values()}, merges)

    def encode_words(self, words: Iterable[str]) -> list[list[int]]:
        return self.automaton.encode([np.frombuffer(w.encode(), np.uint8).astype(np.int64) for w in words])

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.label.__getitem__, ids))


#: White space as the pre-tokenizers see it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Fixed value: the byte-level pre-split pattern of public GPT-2-style vocabularies.
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
