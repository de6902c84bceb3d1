"""Language identification: unigram pieces of a fixed public vocabulary, all segmentations summed.

Each language has probabilities of the vocabulary's pieces. A word's likelihood is the
sum over all its segmentations into pieces (forward algorithm); characters outside the
vocabulary go through its byte pieces. The probabilities are fitted by expectation
maximisation (forward-backward) over the word counts of a bounded sample of documents
for each language. A text's likelihood is the product over its words.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import attach, emit, held_out, raw, stash, words_of

#: Documents of each language that the probabilities are fitted on, about (a sample by hashed id).
SAMPLE = 1_500
ROUNDS = 3
SMOOTH = 0.02
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words up to so many characters are multiplied out; longer ones in logarithms, so that products stay in range.
PLAIN = 24
#: Characters of long words whose edges are held at once, and cells of their tables.
STRETCH, CELLS = 4_096, 200_000
#: Words whose likelihoods a worker remembers; beyond it the memory is emptied, results are the same.
REMEMBERED = 500_000
CHUNK = 4_096


def vocabulary(model_file: str = MODEL) -> list[str]:
    """The pieces of a public SentencePiece model, in the order of their ids."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size())]


class Lattice:
    """Edges (word, start, end, piece) of all segmentations of a list of words, from a trie of the pieces.

    The trie is one sorted array of (node, character) keys; all starts of all words go
    down it together, a character at a time.
    """

    def __init__(self, pieces: dict[str, int]):
        plain = {p: i for p, i in pieces.items() if not (p.startswith("<0x") and p.endswith(">"))}
        self.byte = [pieces.get(f"<0x{b:02X}>", -1) for b in range(256)]
        nodes, keys, ends = {"": 0}, [], {}
        for p, i in plain.items():
            for j in range(1, len(p) + 1):
                if p[:j] not in nodes:
                    nodes[p[:j]] = len(nodes)
                    keys.append((nodes[p[: j - 1]] << 21 | ord(p[j - 1]), nodes[p[:j]]))
            ends[nodes[p]] = i
        keys.sort()
        self.keys = np.array([k for k, _ in keys], np.int64)
        self.next = np.array([n for _, n in keys], np.int64)
        self.longest = max(map(len, plain), default=1)
        self.piece = np.full(len(nodes), -1, np.int64)
        self.piece[list(ends)] = list(ends.values())

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list, np.ndarray]:
        """Word, start, end and piece of each edge (piece -1: the byte pieces, in order), and each word's length."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        text = "".join(words)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        owner = np.repeat(np.arange(len(words)), lengths)
        limit = np.cumsum(lengths)[owner] if len(words) else owner
        begin = np.arange(len(codes))
        at, node, depth = begin, np.zeros(len(codes), np.int64), 0
        starts, ends, found = [], [], []
        alone = np.ones(len(codes), bool)
        while len(at):
            key = node << 21 | codes[at + depth]
            spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[spot] == key
            at, node = at[ok], self.next[spot[ok]]
            depth += 1
            piece = self.piece[node]
            hit = piece >= 0
            starts.append(at[hit])
            ends.append(at[hit] + depth)
            found.append(piece[hit])
            if depth == 1:
                alone[at[hit]] = False
            more = at + depth < limit[at]
            at, node = at[more], node[more]
        odd = np.flatnonzero(alone)
        start, end = np.concatenate([*starts, odd]), np.concatenate([*ends, odd + 1])
        word = owner[start]
        offset = (np.cumsum(lengths) - lengths)[word] if len(words) else word
        spelt = [tuple(self.byte[b] for b in text[i].encode("utf-8", "surrogatepass")) for i in odd.tolist()]
        return word, start - offset, end - offset, np.concatenate([*found, np.full(len(odd), -1)]), spelt, lengths


def _weights(piece: np.ndarray, spelt: list, prob: np.ndarray) -> np.ndarray:
    """Edges x languages; a character of several byte pieces has their product."""
    out = prob[piece]
    for i, p in zip(np.flatnonzero(piece < 0), spelt, strict=True):
        out[i] = prob[list(p)].prod(axis=0)
    return out


def _add(out: np.ndarray, row: np.ndarray, value: np.ndarray) -> None:
    """Sum values by row; rows come in order."""
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    out[row[first]] = np.add.reduceat(value, first, axis=0)


def forward(lattice: Lattice, words: list[str], prob: np.ndarray):
    """Words x languages: likelihoods summed over all segmentations; and what backward needs."""
    word, start, end, piece, spelt, lengths = lattice.edges(words)
    weight = _weights(piece, spelt, prob)
    size = int(lengths.max()) if len(lengths) else 0
    alpha = np.zeros((size + 1, len(words), prob.shape[1]))
    alpha[0] = 1
    order = np.lexsort((word, end))
    bounds = np.searchsorted(end[order], np.arange(1, size + 2))
    for pos in range(1, size + 1):
        at = order[bounds[pos - 1] : bounds[pos]]
        if len(at):
            _add(alpha[pos], word[at], alpha[start[at], word[at]] * weight[at])
    total = alpha[lengths, np.arange(len(words))] if len(words) else np.zeros((0, prob.shape[1]))
    return total, (word, start, end, piece, spelt, lengths, weight, alpha)


def expected(lattice: Lattice, words: list[str], counts: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Expected piece counts (V) of one language: prob is V x 1, counts are the words' counts."""
    total, (word, start, end, piece, spelt, lengths, weight, alpha) = forward(lattice, words, prob)
    size = alpha.shape[0] - 1
    beta = np.zeros_like(alpha)
    beta[lengths, np.arange(len(words))] = 1
    order = np.lexsort((word, start))
    bounds = np.searchsorted(start[order], np.arange(0, size + 1))
    for pos in range(size - 1, -1, -1):
        at = order[bounds[pos] : bounds[pos + 1]]
        if len(at):
            _add(beta[pos], word[at], beta[end[at], word[at]] * weight[at])
    post = alpha[start, word, 0] * weight[:, 0] * beta[end, word, 0] / np.maximum(total[word, 0], 1e-300) * counts[word]
    plain = piece >= 0
    out = np.bincount(piece[plain], post[plain], len(prob))
    for p, x in zip(spelt, post[~plain].tolist(), strict=True):
        for b in p:
            out[b] += x
    return out


def marked(word: str) -> str:
    """The word behind the mark of a word's start; empty without a letter."""
    return "▁" + word.lower() if any(map(str.isalpha, word)) else ""


def stretches(lattice: Lattice, words: list[str], backward: bool = False):
    """Edges of long words by stretches of their starts, and the places of each start among them, in order."""
    size = max(map(len, words))
    begins = range(0, size, STRETCH)
    for begin in reversed(begins) if backward else begins:
        alive = np.array([i for i, w in enumerate(words) if len(w) > begin])
        word, start, end, piece, spelt, _ = lattice.edges([words[i][begin : begin + STRETCH + lattice.longest] for i in alive])
        on = start < STRETCH
        spelt = [p for p, keep in zip(spelt, on[piece < 0].tolist(), strict=True) if keep]
        word, start, end, piece = alive[word[on]], start[on] + begin, end[on] + begin, piece[on]
        order = np.argsort(start, kind="stable")
        places = np.split(order, np.flatnonzero(np.diff(start[order])) + 1)
        yield word, start, end, piece, spelt, places[::-1] if backward else places


def log_forward(lattice: Lattice, words: list[str], prob: np.ndarray) -> np.ndarray:
    """(characters + 1) x words x languages: log of the summed segmentations of every beginning of every word."""
    alpha = np.full((max(map(len, words)) + 1, len(words), prob.shape[1]), -np.inf)
    alpha[0] = 0
    for word, start, end, piece, spelt, places in stretches(lattice, words):
        weight = np.log(_weights(piece, spelt, prob))
        for at in places:  # the ends of a word's edges from one start differ
            alpha[end[at], word[at]] = np.logaddexp(alpha[end[at], word[at]], alpha[start[at], word[at]] + weight[at])
    return alpha


def log_expected(lattice: Lattice, words: list[str], counts: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """``expected`` for long words."""
    alpha, lengths, every = log_forward(lattice, words, prob), np.array([len(w) for w in words]), np.arange(len(words))
    beta = np.full(alpha.shape[:2], -np.inf)
    beta[lengths, every] = 0
    total, out = alpha[lengths, every, 0], np.zeros(len(prob))
    for word, start, end, piece, spelt, places in stretches(lattice, words, backward=True):
        weight = np.log(_weights(piece, spelt, prob))[:, 0]
        for at in places:
            np.logaddexp.at(beta, (start[at], word[at]), weight[at] + beta[end[at], word[at]])
        post = np.exp(alpha[start, word, 0] + weight + beta[end, word] - total[word]) * counts[word]
        out += np.bincount(piece[piece >= 0], post[piece >= 0], len(prob))
        for p, x in zip(spelt, post[piece < 0].tolist(), strict=True):
            np.add.at(out, list(p), x)
    return out


def chunks(words: list[str]):
    """Places of the words that are marked, in pieces of like length and bounded size; whether the piece is of short words."""
    order = sorted((i for i, w in enumerate(words) if w), key=lambda i: len(words[i]))
    held: list[int] = []
    for i in order:
        long = len(words[i]) > PLAIN
        if held and (len(held) >= CHUNK or (long and (len(words[held[-1]]) <= PLAIN or (len(held) + 1) * len(words[i]) > CELLS))):
            yield held, len(words[held[-1]]) <= PLAIN
            held = []
        held.append(i)
    if held:
        yield held, len(words[held[-1]]) <= PLAIN


def log_likelihoods(lattice: Lattice, words: list[str], prob: np.ndarray) -> np.ndarray:
    """Words x languages: log of the probabilities summed over all segmentations; 0 for an empty word."""
    out = np.zeros((len(words), prob.shape[1]))
    for at, short in chunks(words):
        own = [words[i] for i in at]
        if short:
            out[at] = np.log(np.maximum(forward(lattice, own, prob)[0], 1e-300))
        else:
            out[at] = log_forward(lattice, own, prob)[[len(w) for w in own], np.arange(len(own))]
    return out


def expected_pieces(lattice: Lattice, words: list[str], counts: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Expected piece counts of one language (prob: V x 1), whatever the words' lengths."""
    total = np.zeros(len(prob))
    for at, short in chunks(words):
        total += (expected if short else log_expected)(lattice, [words[i] for i in at], counts[at], prob)
    return total


def _sampled(docs: DataFrame, per_language: int) -> DataFrame:
    """(lang, w, n): word counts of about ``per_language`` documents of each language, none held out."""
    learn = docs.where(~held_out()).where("lang is not null and text is not null")
    counts = learn.groupBy("lang").count()
    part = F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("count"))
    roll = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # one row a language
    rows = learn.join(F.broadcast(counts), "lang").where(roll < part).select("lang", "text")

    def make():
        def run(batch):
            c: Counter = Counter()
            for lang, data in zip(batch.column("lang").to_pylist(), raw(batch, "text"), strict=True):
                c.update((lang, w) for w in words_of(data))
            return [[lang for lang, _ in c], [w.decode() for _, w in c], list(c.values())]

        return run

    return stash(emit(rows, "lang string, w string, n bigint", make).groupBy("lang", "w").agg(F.sum("n").alias("n")), "words")


def fit_languages(docs: DataFrame, per_language: int = SAMPLE, model_file: str = MODEL) -> tuple[list[str], np.ndarray]:
    """Learned languages, and log probabilities (pieces x languages)."""
    sc = docs.sparkSession.sparkContext
    pieces = vocabulary(model_file)
    words = _sampled(docs, per_language)
    langs = [r[0] for r in words.select("lang").distinct().orderBy("lang").collect()]
    if not langs:
        return [], np.zeros((len(pieces), 0))
    v = len(pieces)
    prob = np.full((v, len(langs)), 1.0 / v)
    table = sc.broadcast({p: i for i, p in enumerate(pieces)})
    for _ in range(ROUNDS):
        held = sc.broadcast(prob)

        def make(held=held):
            lattice, p = Lattice(table.value), held.value

            def run(batch):
                out_lang, out_piece, out_n = [], [], []
                lang = np.array(batch.column("lang").to_pylist(), object)
                every = batch.column("w").to_pylist()
                counts = np.array(batch.column("n").to_pylist(), float)
                for k, name in enumerate(langs):
                    rows = np.flatnonzero(lang == name)
                    total = expected_pieces(lattice, [marked(every[j]) for j in rows], counts[rows], p[:, k : k + 1])
                    some = np.flatnonzero(total)
                    out_lang += [k] * len(some)
                    out_piece += some.tolist()
                    out_n += total[some].tolist()
                return [out_lang, out_piece, out_n]

            return run

        rows = emit(words, "k int, piece int, n double", make).groupBy("k", "piece").agg(F.sum("n").alias("n")).toPandas()
        prob = np.full((v, len(langs)), SMOOTH)
        np.add.at(prob, (rows["piece"].to_numpy(), rows["k"].to_numpy()), rows["n"].to_numpy())
        prob /= prob.sum(axis=0)
    return langs, np.log(prob)


def identify(docs: DataFrame, per_language: int = SAMPLE, model_file: str = MODEL) -> DataFrame:
    """``docs`` with held_out, lang_pred and score (the posterior of lang_pred, 0 to 1).

    docs: doc_id, text, lang. Only rows that are not held out (crc32 of the id as text
    leaves 2 when divided by 4) with text and lang are learned from. Null texts and texts
    without a letter are ``und`` with score 0; so is everything if nothing was learned.
    Equal posteriors go to the first language in order; repeated rows get equal results.
    Texts and words may have any length: all segmentations of whole words are summed. An
    empty table gives an empty one. Input columns named like a result give way to it, in
    any case of letters.
    """
    langs, log_prob = fit_languages(docs, per_language, model_file)
    sc = docs.sparkSession.sparkContext
    held = sc.broadcast(np.exp(log_prob))
    table = sc.broadcast({p: i for i, p in enumerate(vocabulary(model_file))})
    # a worker keeps a broadcast's value from task to task: its words' likelihoods stay there, computed once a worker
    memory = sc.broadcast({"rows": {}, "known": np.zeros((1 << 14, len(langs) + 1))})
    k = len(langs)

    def make():
        memo, prob = memory.value, held.value
        lattice = memo.get("lattice") or memo.setdefault("lattice", Lattice(table.value))
        rows: dict[bytes, int] = memo["rows"]

        def learn(new: list[bytes]) -> None:
            for i in range(0, len(new), CHUNK):
                part = new[i : i + CHUNK]
                words = [marked(w.decode()) for w in part]
                value = np.zeros((len(part), k + 1))
                if k:
                    value[:, :k] = log_likelihoods(lattice, words, prob)
                    value[:, k] = [len(w) > 0 for w in words]
                known, need = memo["known"], len(rows) + len(part)
                if need > len(known):
                    memo["known"] = known = np.concatenate([known, np.zeros((max(need - len(known), len(known)), k + 1))])
                known[len(rows) : need] = value
                for w in part:
                    rows[w] = len(rows)

        def run(batch):
            pred, score = [], []
            for data in raw(batch, "text"):
                c = words_of(data)
                if len(rows) > REMEMBERED:
                    rows.clear()
                new = list({w for w in c if w not in rows})
                if new:
                    learn(sorted(new))
                ll = memo["known"][[rows[w] for w in c]].sum(axis=0) if c else np.zeros(k + 1)
                if not k or not ll[k]:
                    pred.append("und")
                    score.append(0.0)
                    continue
                p = np.exp(ll[:k] - ll[:k].max())
                best = int(p.argmax())
                pred.append(langs[best])
                score.append(float(p[best] / p.sum()))
            return [pa.array(pred, pa.string()), score]

        return run

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return attach(docs, "text", fields, make).withColumn("held_out", held_out())
