"""Stateful next-token models: a session takes one token at a time and gives the probabilities of the next.

`NeuralSession` feeds a recurrent network that an ONNX runtime holds; no weights come with this package. `MockSession` is its
deterministic stand-in. A session is made for each worker and reset for each stream.
"""

from __future__ import annotations

import copy
import zlib
from collections.abc import Callable

import numpy as np

from .coder import Decoder, Encoder
from .models import LAYERS, VOCABULARY, WIDTH, MockModel, cumulative_array, softmax_array


class Session:
    """A state that each token changes. `size` is the number of tokens, `hash` names the model."""

    size: int
    hash: int

    def reset(self) -> None:
        raise NotImplementedError

    def process_token(self, token: int) -> np.ndarray:
        """The next token's probabilities, float32, after this one."""
        raise NotImplementedError

    def process_tokens(self, tokens: list[int]) -> list[np.ndarray]:
        return [self.process_token(t) for t in tokens]

    def get_state(self):
        """A copy, which later tokens don't change."""
        return copy.deepcopy(self.state)

    def set_state(self, state) -> None:
        self.state = copy.deepcopy(state)


class MockSession(Session):
    """MockModel, token by token; its state is the number of tokens since the last reset."""

    def __init__(self, size: int = 320):
        self.model = MockModel(size)
        self.size, self.hash, self.state = size, zlib.crc32(b"mock session %d" % size), 0

    def reset(self) -> None:
        self.state = 0

    def process_token(self, token: int) -> np.ndarray:
        p = self.model.probabilities(np.array([token]), self.state)[0]
        self.state += 1
        return p


class NeuralSession(Session):
    """A recurrent network: the token goes in the last of `context` places of `idx`, with five states of layers x width; out come
    logits `x` and the states, their names ending in `_r`. `runtime` has run(names, feeds) as an ONNX InferenceSession has."""

    # The names of the states.
    STATES = ("xx_att", "aa_att", "bb_att", "pp_att", "xx_ffn")

    def __init__(self, runtime, layers: int = LAYERS, width: int = WIDTH, size: int = VOCABULARY, context: int = 1024):
        self.runtime, self.shape, self.size, self.context = runtime, (layers, width), size, context
        self.hash = layers * 1_000_000 + width * 1_000 + size
        self.reset()

    @classmethod
    def load(cls, path: str, **config) -> NeuralSession:
        """A model file, on one thread of the CPU: Spark's tasks are the parallelism."""
        import onnxruntime as ort

        options = ort.SessionOptions()
        options.intra_op_num_threads = options.inter_op_num_threads = 1
        return cls(ort.InferenceSession(path, options, providers=["CPUExecutionProvider"]), **config)

    def reset(self) -> None:
        self.state = {k: np.full(self.shape, -1e30 if k == "pp_att" else 0, np.float32) for k in self.STATES}

    def process_token(self, token: int) -> np.ndarray:
        idx = np.zeros(self.context, np.int32)
        idx[-1] = token
        logits, *states = self.runtime.run(["x", *(f"{k}_r" for k in self.STATES)], {"idx": idx, **self.state})
        self.state = dict(zip(self.STATES, states, strict=True))
        return softmax_array(np.asarray(logits, np.float32).reshape(-1))


class SessionModel:
    """A model that codes with sessions, one token at a time. `make` is called once in each worker."""

    def __init__(self, make: Callable[[], Session], size: int, hash_: int):
        self.make, self.size, self.hash, self._own = make, size, hash_, None

    def __getstate__(self):
        return self.__dict__ | {"_own": None}

    def _session(self) -> Session:
        if self._own is None:
            self._own = self.make()
        self._own.reset()
        return self._own

    def encode(self, streams: list[np.ndarray]) -> list[bytes]:
        out = []
        for tokens in streams:
            session, coder, last = self._session(), Encoder(), 0
            for t in tokens.tolist():
                row = cumulative_array(session.process_token(last))
                coder.push(int(row[t]), int(row[t + 1]), int(row[-1]))
                last = t
            out.append(coder.finish() if len(tokens) else b"")
        return out

    def decode(self, payloads: list[bytes], counts: list[int]) -> list[np.ndarray]:
        out = []
        for data, n in zip(payloads, counts, strict=True):
            session, coder, found = self._session(), Decoder(data), [0]
            for _ in range(n):
                found.append(coder.pull(cumulative_array(session.process_token(found[-1])).tolist()))
            out.append(np.array(found[1:], np.int64))
        return out
