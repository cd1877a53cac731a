"""A linear-chain conditional random field over words, in numpy.

A word's score for a label is the sum of its features' weights: the word itself,
prefixes and suffixes of 1 to 5 bytes, inner 2- to 4-grams of bytes, and the
lexicon that it stands in. Labels of neighbours are tied by learned transitions.
Forward-backward gives each word's probability of each label. Features are hashed
into a fixed number of buckets, so a model's size is bounded.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lodestone.llm.common import ascii_lower, mix64, split_runs

BUCKETS = 1 << 18
BLOCK = 64
_AFFIX = 5

#: A word is a run of ASCII letters and bytes of other letters.
NO_LETTER = np.ones(256, bool)
NO_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _bucket(values: np.ndarray, template: int) -> np.ndarray:
    return (mix64(values.astype(np.uint64) + np.uint64(template * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(BUCKETS)).astype(np.int64)


def features(types: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct words: feature buckets, the word of each, and the words' hashes."""
    low = pc.utf8_lower(types.cast(pa.large_string()))
    n = len(low)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    _, offsets, data = low.buffers()
    off = np.frombuffer(offsets, np.int64, count=n + 1, offset=8 * low.offset)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]].astype(np.uint64)
    off = off - off[0]
    starts, sizes = off[:-1], np.diff(off)
    owner = np.repeat(np.arange(n), sizes)
    place = np.arange(len(raw)) - starts[owner]
    hashes = mix64(np.add.reduceat(mix64(raw + (place.astype(np.uint64) << np.uint64(8))), starts))
    found, whose = [_bucket(hashes, 1)], [np.arange(n)]
    padded = np.concatenate([raw, np.zeros(_AFFIX, np.uint64)])
    front, back = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for k in range(_AFFIX):
        long = np.flatnonzero(sizes > k)
        front[long] = front[long] << np.uint64(8) | raw[starts[long] + k]
        back[long] = back[long] << np.uint64(8) | raw[starts[long] + sizes[long] - 1 - k]
        found += [_bucket(front[long], 10 + k), _bucket(back[long], 20 + k)]
        whose += [long, long]
    gram = raw.copy()
    for k in range(1, 4):
        gram = gram << np.uint64(8) | padded[k : k + len(raw)]
        inside = np.flatnonzero(place + k < sizes[owner])
        found.append(_bucket(gram[inside], 30 + k))
        whose.append(owner[inside])
    return np.concatenate(found), np.concatenate(whose), hashes


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # by bucket and label
    transitions: np.ndarray
    #: Sorted hashes of lexicon words, the lexicon of each, and weights by lexicon and label.
    lexicon: np.ndarray
    lexicon_of: np.ndarray
    lexicon_weights: np.ndarray
    extra: dict = field(default_factory=dict)

    def emissions(self, types: pa.Array) -> np.ndarray:
        """Scores of distinct words, by word and label."""
        found, whose, hashes = features(types)
        out = np.stack([np.bincount(whose, weights=self.weights[found, k], minlength=len(types)) for k in range(len(self.labels))], axis=1).astype(float)
        at, known = lexicon_places(self.lexicon, hashes)
        out[known] += self.lexicon_weights[self.lexicon_of[at[known]]]
        return out


def lexicon_places(lexicon: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(lexicon):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)
    return at, lexicon[at] == hashes


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray, pa.Array]:
    """Words of texts, each text's offset into them, each word's first byte, the texts."""
    low = ascii_lower(texts)
    words, offsets, first = split_runs(low, NO_LETTER)
    return words, offsets, first, low


def _expected(scores: np.ndarray) -> np.ndarray:
    return np.exp(scores - scores.max(axis=-1, keepdims=True))


def marginals(scores: np.ndarray, offsets: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Each word's label probabilities, by forward-backward over whole texts."""
    return forward_backward(scores, offsets, transitions)[0]


def forward_backward(scores: np.ndarray, offsets: np.ndarray, transitions: np.ndarray, count_pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Each word's label probabilities, and the expected number of each pair of labels
    over all neighbours (zeros unless asked for).

    Texts are cut into blocks that are run side by side. What a block passes on is a
    product of matrices; from these, taken in order, each block's inputs follow, so
    the result is that of an unbroken run. A text's first word has no transition.
    """
    n, k = scores.shape
    pairs = np.zeros((k, k))
    if not n:
        return np.zeros((0, k)), pairs
    tie = np.exp(transitions)
    lengths = np.diff(offsets)
    blocks = -(-lengths // BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)])
    count = int(first[-1])
    text = np.repeat(np.arange(len(lengths)), blocks)
    turn = np.arange(count) - first[text]
    lead = np.flatnonzero(turn == 0)
    begin = offsets[text] + turn * BLOCK
    size = np.minimum(BLOCK, offsets[text + 1] - begin)
    steps = int(size.max())
    own = np.ones((steps, count, k))
    inside = np.arange(steps)[:, None] < size
    place = (begin + np.arange(steps)[:, None])[inside]
    own[inside] = _expected(scores)[place]

    # what each block makes of its input
    passed = np.broadcast_to(np.eye(k), (count, k, k)).copy()
    for t in range(steps):
        live = slice(None) if inside[t].all() else np.flatnonzero(inside[t])
        now = np.matmul(passed[live], tie) * own[t, live][:, None, :]
        passed[live] = now / now.sum(axis=(1, 2), keepdims=True)
        if not t:
            passed[lead] = np.eye(k) * (own[0, lead] / own[0, lead].sum(axis=1, keepdims=True))[:, None, :]
    into, out_of = np.full((count, k), 1 / k), np.full((count, k), 1.0)
    for j in range(1, int(blocks.max(initial=0))):
        at = first[:-1][blocks > j] + j
        now = np.matmul(into[at - 1][:, None, :], passed[at - 1])[:, 0]
        into[at] = now / now.sum(axis=1, keepdims=True)
        at = first[1:][blocks > j] - 1 - j
        now = np.matmul(passed[at + 1], out_of[at + 1][:, :, None])[:, :, 0]
        out_of[at] = now / now.sum(axis=1, keepdims=True)

    forward = np.empty((steps, count, k))
    now = into
    for t in range(steps):
        step = now @ tie * own[t]
        if not t:
            step[lead] = own[0, lead]
        now = np.where(inside[t][:, None], step / step.sum(axis=1, keepdims=True), now)
        forward[t] = now
    backward = out_of
    for t in range(steps - 1, -1, -1):
        ahead = own[t] * backward
        if count_pairs:
            here = np.flatnonzero(inside[t] & ((turn > 0) | (t > 0)))
            left, right = (forward[t - 1] if t else into)[here], ahead[here]
            share = ((left @ tie) * right).sum(axis=1, keepdims=True)
            pairs += (left / share).T @ right * tie
        forward[t] *= backward  # now the marginals, but for a factor
        step = ahead @ tie.T
        backward = np.where(inside[t][:, None], step / step.sum(axis=1, keepdims=True), backward)
    out = np.empty((n, k))
    out[place] = forward[inside]
    return out / out.sum(axis=1, keepdims=True), pairs


class Likelihood:
    """The mean log-likelihood of tagged sequences, less weight decay, by its gradient."""

    def __init__(self, k: int, types: pa.Array, sequences: list[np.ndarray], tags: list[np.ndarray], lexicons: dict[int, np.ndarray], decay: float):
        found, self.whose, hashes = features(types)
        lex = np.concatenate([np.zeros(0, np.int64), *lexicons.values()])
        lex_of = np.concatenate([np.zeros(0, np.int64), *[np.full(len(v), i) for i, v in enumerate(lexicons.values())]])
        order = np.argsort(hashes[lex])
        self.lexicon, self.lexicon_of = hashes[lex][order], lex_of[order]
        at, known = lexicon_places(self.lexicon, hashes)
        self.known = np.flatnonzero(known)
        self.list_of = self.lexicon_of[at[self.known]]
        self.used, self.at_used = np.unique(found, return_inverse=True)
        self.words, self.gold = np.concatenate(sequences), np.concatenate(tags)
        self.offsets = np.concatenate([[0], np.cumsum([len(s) for s in sequences])])
        inner = np.ones(len(self.words), bool)
        inner[self.offsets[:-1]] = False
        pairs = np.flatnonzero(inner)
        self.gold_pairs = np.zeros((k, k))
        np.add.at(self.gold_pairs, (self.gold[pairs - 1], self.gold[pairs]), 1)
        self.k, self.types, self.decay = k, len(types), decay
        self.start = [np.zeros((len(self.used), k)), np.zeros((k, k)), np.zeros((max(1, len(lexicons)), k))]

    def scores(self, params: list[np.ndarray]) -> np.ndarray:
        by_type = np.stack([np.bincount(self.whose, weights=params[0][self.at_used, j], minlength=self.types) for j in range(self.k)], axis=1)
        by_type[self.known] += params[2][self.list_of]
        return by_type[self.words]

    def gradient(self, params: list[np.ndarray]) -> list[np.ndarray]:
        n, k = len(self.words), self.k
        p, expected = forward_backward(self.scores(params), self.offsets, params[1], count_pairs=True)
        off = -p
        off[np.arange(n), self.gold] += 1
        by_type = np.stack([np.bincount(self.words, weights=off[:, j], minlength=self.types) for j in range(k)], axis=1)
        by_bucket = np.stack([np.bincount(self.at_used, weights=by_type[self.whose, j], minlength=len(self.used)) for j in range(k)], axis=1)
        by_list = np.stack([np.bincount(self.list_of, weights=by_type[self.known, j], minlength=len(params[2])) for j in range(k)], axis=1)
        return [g / n - self.decay * x for g, x in zip((by_bucket, self.gold_pairs - expected, by_list), params, strict=True)]


def fit(labels: list[str], types: pa.Array, sequences: list[np.ndarray], tags: list[np.ndarray], lexicons: dict[int, np.ndarray], rounds: int = 40, rate: float = 0.15, decay: float = 1e-4, extra: dict | None = None) -> Model:
    """Maximum likelihood with weight decay, by Adam over all sequences at once.

    ``sequences``: words, as places in ``types``; ``tags``: the label of each;
    ``lexicons``: places in ``types`` of the words of each lexicon.
    """
    goal = Likelihood(len(labels), types, sequences, tags, lexicons, decay)
    params = goal.start
    moment, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for turn in range(1, rounds + 1):
        for x, grad, m, v in zip(params, goal.gradient(params), moment, square, strict=True):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            x += rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    weights = np.zeros((BUCKETS, len(labels)), np.float32)
    weights[goal.used] = params[0]
    return Model(labels, weights, params[1], goal.lexicon, goal.lexicon_of, params[2], extra or {})
