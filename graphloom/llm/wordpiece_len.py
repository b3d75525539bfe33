"""Token counts: the number of greedy (longest-match-first) word pieces, without building pieces.

A trie over the vocabulary's bytes, with failure links and the number of tokens that following a link pops,
is an automaton that reads each byte of a word once (linear longest match).  ``Automaton.build`` packs it
into a double array; ``Automaton.lengths`` moves all words of a batch through it in lockstep.

Words are ``[^\\x20\\x09-\\x0D]+``.  The first piece of a word is looked up as is, later ones with a
continuation prefix; a word that cannot be covered is one unknown token.

Defined cases: null and empty texts have no tokens; null and repeated ids keep their rows; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as K
from .sentencepiece_backend import MARK, MODEL, NORMAL, Model, _read

#: Longer words go through a scalar loop, so that a few of them do not hold up a batch.
LONG = 2048


def vocabulary(path: str = MODEL) -> tuple[list[str], list[str]]:
    """Initial and continuing pieces of a SentencePiece vocabulary: with and without the word marker."""
    pieces = [p for p, _, kind in Model(_read(path)).pieces if kind == NORMAL]
    first = [p[1:] for p in pieces if p.startswith(MARK) and p[1:] and MARK not in p[1:]]
    return first, [p for p in pieces if MARK not in p]


class Automaton:
    """base and check: node n has a child for byte c at s = base[n] + c if check[s] == n. link: the node after
    a failure (-1: none); popped: tokens that this pops. Node 0 begins a word, node 1 follows a piece."""

    def __init__(self, base, check, link, popped):
        self.base, self.check, self.link, self.popped = base, check, link, popped

    @classmethod
    def build(cls, first: list[str], rest: list[str]) -> Automaton:
        children: list[dict[int, int]] = [{}, {}]
        token = [False, False]
        for root, pieces in ((0, first), (1, rest)):
            for p in pieces:
                node = root
                for c in p.encode():
                    nxt = children[node].get(c)
                    if nxt is None:
                        nxt = children[node][c] = len(children)
                        children.append({})
                        token.append(False)
                    node = nxt
                token[node] = node > 1
        link, popped = [-1] * len(children), [0] * len(children)
        queue = [0, 1]
        for v in queue:  # breadth first: shorter strings are done
            for c, u in children[v].items():
                queue.append(u)
                if token[u]:
                    link[u], popped[u] = 1, 1
                    continue
                z, n = link[v], popped[v]
                while z >= 0 and c not in children[z]:
                    n += popped[z]
                    z = link[z]
                if z >= 0:
                    link[u], popped[u] = children[z][c], n
        # Double array: nodes with many children are placed first, single children fill the gaps.
        room = 2 * len(children) + 1024
        base, check, slot = np.zeros(room, np.int32), np.full(room, -1, np.int32), np.zeros(len(children), np.int32)
        used = np.zeros(room, bool)
        used[:2] = True
        slot[1] = 1
        free_at = hint = 2
        used = used.tolist()
        where = {}
        for v in sorted(range(len(children)), key=lambda v: -len(children[v])):
            cs = sorted(children[v])
            if not cs:
                break
            while used[free_at]:
                free_at += 1
            s = free_at if len(cs) == 1 else max(free_at, hint)
            while True:
                b = s - cs[0]
                if b + 256 >= room:
                    grow = room
                    base, check, used = np.concatenate([base, np.zeros(grow, np.int32)]), np.concatenate([check, np.full(grow, -1, np.int32)]), used + [False] * grow
                    room += grow
                if not used[s] and (len(cs) == 1 or not any(used[b + c] for c in cs)):
                    break
                s += 1
            where[v] = b
            hint = s if len(cs) > 1 else hint  # many children: never search a stretch twice
            for c in cs:
                used[b + c] = True
                slot[children[v][c]] = b + c
        for v, b in where.items():
            base[slot[v]] = b
            for c in children[v]:
                check[b + c] = slot[v]
        lo, po = np.full(room, -1, np.int32), np.zeros(room, np.int32)
        lo[slot] = [slot[x] if x >= 0 else -1 for x in link]
        po[slot] = popped
        # A base may be negative or lead past the end; both sides are padded so that every byte can be looked up.
        shift = max(0, -int(base.min()))
        check = np.concatenate([np.full(shift, -1, np.int32), check, np.full(256, -1, np.int32)])
        return cls(np.concatenate([base, np.zeros(256, np.int32)]) + shift, np.where(check >= 0, check, -1), np.concatenate([lo, np.full(256, -1, np.int32)]), np.concatenate([po, np.zeros(256, np.int32)])).shifted(shift)

    def shifted(self, shift: int) -> Automaton:
        self.shift = shift
        return self

    def lengths(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of each word buf[start:end]."""
        size = end - start
        out = np.zeros(len(size), np.int64)
        order = np.argsort(-size, kind="stable")
        n_long = int(np.searchsorted(-size[order], -LONG, side="left"))
        for w in order[:n_long].tolist():
            out[w] = self.length(buf[start[w] : end[w]].tobytes())
        order = order[n_long:]
        if not len(order):
            return out
        begin, left = start[order], size[order]
        node, count = np.zeros(len(order), np.int32), np.zeros(len(order), np.int64)
        dead = np.zeros(len(order), bool)
        base, check, link, popped, shift = self.base, self.check, self.link, self.popped, self.shift
        for j in range(int(left[0])):
            live = int(np.searchsorted(-left, -j, side="left"))  # words longer than j
            c = buf[begin[:live] + j]
            here = node[:live]
            to = base[here] + c
            miss = np.flatnonzero(check[to] != here)
            while len(miss):
                at = here[miss]
                nxt = link[at]
                lost = nxt < 0
                dead[miss[lost]] = True
                go = miss[~lost]
                count[go] += popped[at[~lost]]
                here[go] = nxt[~lost]
                to[go] = base[here[go]] + c[go]
                miss = go[check[to[go]] != here[go]]
            here[:] = to - shift
            if dead[:live].any():  # a lost word stays in a state without children
                here[dead[:live]] = 0
        todo = np.flatnonzero(~dead & (node != 1))
        while len(todo):
            nxt = link[node[todo]]
            lost = nxt < 0
            dead[todo[lost]] = True
            todo, nxt = todo[~lost], nxt[~lost]
            count[todo] += popped[node[todo]]
            node[todo] = nxt
            todo = todo[nxt != 1]
        count[dead] = 1
        out[order] = count
        return out

    def length(self, word: bytes) -> int:
        base, check, link, popped, shift = self.base, self.check, self.link, self.popped, self.shift
        node = count = 0
        for c in word:
            while check[base[node] + c] != node:
                if link[node] < 0:
                    return 1
                count += int(popped[node])
                node = link[node]
            node = base[node] + c - shift
        while node != 1:
            if link[node] < 0:
                return 1
            count += int(popped[node])
            node = link[node]
        return count


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", first: list[str] | None = None, rest: list[str] | None = None, path: str = MODEL) -> DataFrame:
    """(doc_id, n_words, n_tokens) of every row's whole text. Tables broadcast: some bytes a vocabulary byte."""
    if first is None or rest is None:
        first, rest = vocabulary(path)
    tables = docs.sparkSession.sparkContext.broadcast(Automaton.build(first, rest))

    def run(batches):
        auto = tables.value
        for batch in batches:
            buf, off = K.string_buffer(batch.column(1))
            for i, j in K.chunks(off):
                part = buf[off[i] : off[j]]
                s, e, wo = K.word_spans(part, off[i : j + 1] - off[i])
                total = np.concatenate([[0], np.cumsum(auto.lengths(part, s, e))])
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(np.diff(wo), pa.int64()), pa.array(np.diff(total[wo]), pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return K.small_batches(rows).mapInArrow(K.tidy(run), "doc_id long, n_words long, n_tokens long")


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
