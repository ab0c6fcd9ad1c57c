"""Forward and backward recursions over many sequences at once, laid out by time."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: Tokens of a part of a long sequence, and labels up to which parts are multiplied: products of parts cost labels times as much a token as steps do.
PART, PRODUCT_LABELS = 64, 16


class Layout(NamedTuple):
    """order: sequences from longest to shortest; alive: how many have a place at each time; place: where each time begins; at: the places' tokens."""

    order: np.ndarray
    alive: np.ndarray
    place: np.ndarray
    at: np.ndarray


def layout(first: np.ndarray) -> Layout:
    """Of sequences first[i]:first[i + 1] of an array of tokens."""
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    alive = np.searchsorted(-lengths[order], -np.arange(1, lengths.max(initial=0) + 1), side="right")
    begin = first[:-1][order]
    at = np.concatenate([begin[:n] + t for t, n in enumerate(alive)]) if len(alive) else np.zeros(0, np.int64)
    return Layout(order, alive, np.concatenate([[0], np.cumsum(alive)]), at)


def forward_backward(lay: Layout, start: np.ndarray, move: np.ndarray, emitted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors (places, K), scales (places), and the expected moves (K, K) over all sequences.

    start: (sequences in lay.order, K); emitted: (places, K) likelihoods of the tokens. The sum of the scales' logarithms is the
    log-likelihood.
    """
    k, (_, alive, place, _) = len(move), lay
    alpha, scale = np.empty((len(emitted), k)), np.empty(len(emitted))
    for t, n in enumerate(alive):
        here = slice(place[t], place[t] + n)
        a = (alpha[place[t - 1] : place[t - 1] + n] @ move if t else start[:n]) * emitted[here]
        scale[here] = a.sum(1)
        alpha[here] = a / scale[here][:, None]
    moves, beta = np.zeros((k, k)), np.ones((0, k))
    for t in range(len(alive) - 1, -1, -1):
        now = np.ones((alive[t], k))
        if len(beta):
            ahead = slice(place[t + 1], place[t + 1] + len(beta))
            u = beta * emitted[ahead] / scale[ahead][:, None]
            moves += alpha[place[t] : place[t] + len(beta)].T @ u
            now[: len(beta)] = u @ move.T
        beta = now
        alpha[place[t] : place[t + 1]] *= beta  # from here on, the posteriors
    return alpha, scale, moves * move


def posteriors(first: np.ndarray, start: np.ndarray, move: np.ndarray, emitted: np.ndarray) -> np.ndarray:
    """forward_backward()'s posteriors (tokens, K) over whole sequences first[i]:first[i + 1], all with one start (K).

    Sequences are cut into parts of PART tokens. A part is a product of K by K matrices, which all parts make at once; what comes into
    each part and out of it follows from these products, and then the parts' tokens are met side by side. So there are about PART steps
    and as many as the longest sequence has parts, where steps along it are as many as its tokens.
    """
    lengths, k = np.diff(first), len(move)
    if k > PRODUCT_LABELS or lengths.max(initial=0) <= 2 * PART:
        lay, out = layout(first), np.empty((len(emitted), k))
        out[lay.at] = forward_backward(lay, np.broadcast_to(start, (len(lay.order), k)), move, emitted[lay.at])[0]
        return out
    parts = -(-lengths // PART)
    ends = np.cumsum(parts)
    nth = np.arange(ends[-1]) - np.repeat(ends - parts, parts)
    lay = layout(np.append(np.repeat(first[:-1], parts) + nth * PART, first[-1]))
    e, (order, alive, place, at) = emitted[lay.at], lay
    opens = (nth == 0)[order][:, None]
    x = np.where(opens[:, :, None], np.diag(start), move) * e[: len(order), None]
    x /= x.sum((1, 2), keepdims=True)
    for t, n in enumerate(alive[1:], 1):
        y = (x[:n].reshape(-1, k) @ move).reshape(n, k, k) * e[place[t] : place[t + 1], None]
        x[:n] = y / y.sum((1, 2), keepdims=True)
    product = np.empty_like(x)
    product[order] = x
    into, out_of, along = np.ones((len(order), k)), np.ones((len(order), k)), layout(np.append(0, ends))
    steps = [(along.at[along.place[t - 1] : along.place[t - 1] + n], along.at[along.place[t] : along.place[t + 1]]) for t, n in enumerate(along.alive[1:], 1)]
    for one, other in steps:
        y = (into[one][:, None] @ product[one])[:, 0]
        into[other] = y / y.sum(1, keepdims=True)
    for one, other in reversed(steps):
        y = (product[other] @ out_of[other][:, :, None])[:, :, 0]
        out_of[one] = y / y.sum(1, keepdims=True)
    alpha, scale = np.empty_like(e), np.empty((len(e), 1))
    for t, n in enumerate(alive):
        here = slice(place[t], place[t + 1])
        a = (alpha[place[t - 1] : place[t - 1] + n] @ move if t else np.where(opens, start, into[order] @ move)) * e[here]
        scale[here] = a.sum(1, keepdims=True)
        alpha[here] = a / scale[here]
    beta, out_of = np.ones((0, k)), out_of[order]
    for t in range(len(alive) - 1, -1, -1):
        now, own = out_of[: alive[t]].copy(), alpha[place[t] : place[t + 1]]
        last = slice(len(beta), None)  # the parts that end here
        now[last] /= (own[last] * now[last]).sum(1, keepdims=True)
        if len(beta):
            ahead = slice(place[t + 1], place[t + 2])
            now[: len(beta)] = (beta * e[ahead] / scale[ahead]) @ move.T
        beta = now
        own *= beta  # from here on, the posteriors
    out = np.empty_like(e)
    out[at] = alpha
    return out
