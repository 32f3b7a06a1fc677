"""An embedder of texts by an ONNX encoder on whatever hardware a worker has."""

from __future__ import annotations

import os

import numpy as np

from loomnote.operators import search


class OnnxEmbedder:
    """Maps texts to the encoder's state of their first token; ``search.embed`` scales them to length 1.

    ``folder`` holds ``model.onnx`` and ``tokenizer.json`` and has to be on every worker. Only the path travels: each
    worker loads the model once, with the providers that it has, CUDA before DirectML before CPU.
    """

    def __init__(self, folder: str, most_tokens: int = 512):
        self.folder, self.most_tokens = folder, most_tokens
        self._loaded = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_loaded": None}

    def _load(self):
        if self._loaded is None:
            import onnxruntime
            from tokenizers import Tokenizer

            model = onnxruntime.InferenceSession(os.path.join(self.folder, "model.onnx"), providers=search.providers())
            words = Tokenizer.from_file(os.path.join(self.folder, "tokenizer.json"))
            words.enable_truncation(self.most_tokens)
            words.enable_padding()
            self._loaded = model, words, {x.name for x in model.get_inputs()}
        return self._loaded

    def __call__(self, texts: list[str]) -> np.ndarray:
        model, words, wanted = self._load()
        found = words.encode_batch(list(texts))
        given = {"input_ids": [e.ids for e in found], "attention_mask": [e.attention_mask for e in found], "token_type_ids": [e.type_ids for e in found]}
        state = model.run(None, {k: np.asarray(v, dtype=np.int64) for k, v in given.items() if k in wanted})[0]
        return state[:, 0] if state.ndim == 3 else state
