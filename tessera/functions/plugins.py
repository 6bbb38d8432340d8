"""Extension surfaces.

X1  A detector plug-in is any Python callable ``texts (pandas Series) ->
    list of span lists``; it runs as an Arrow-batched pandas UDF whose output
    has the same ``array<span>`` type as the native recognizers, so plug-in
    spans concatenate with native ones and flow into redaction and policy.
    A model is loaded once per Python worker (``loader`` is cached).
X2  Custom anonymisation operators: ``register_operator(name, fn)`` where
    ``fn(span_text: Column, entity_type: Column) -> Column``.
X3  ``ScanSettings`` keeps the knobs the reference passes around as a dict.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .spans import SPAN

_MODELS: dict[str, object] = {}


def model_detector(detect: Callable, name: str = "model", loader: Callable | None = None,
                   score_floor: float = 0.0) -> Callable[[Column], Column]:
    """Wrap ``detect(texts, model) -> [[{entity_type, start, end, score}]]``.

    Returns ``Column -> Column`` (array<span>).  ``loader()`` builds the model
    the first time a worker needs it; later batches reuse it.
    """
    out_type = T.ArrayType(SPAN)

    @F.pandas_udf(out_type)
    def _udf(texts: pd.Series) -> pd.Series:
        model = None
        if loader is not None:
            if name not in _MODELS:
                _MODELS[name] = loader()
            model = _MODELS[name]
        found = detect(texts, model)
        rows = []
        for text, spans in zip(texts, found):
            keep = []
            for s in spans or []:
                if s.get("score", 0.0) < score_floor:
                    continue
                st, en = int(s["start"]), int(s["end"])
                keep.append({"entity_type": s["entity_type"], "start": st, "end": en,
                             "score": float(s.get("score", 0.0)),
                             "text": s.get("text", (text or "")[st:en])})
            rows.append(keep)
        return pd.Series(rows)

    return lambda text: _udf(F.col(text) if isinstance(text, str) else text)


CUSTOM_OPERATORS: dict[str, Callable[[Column, Column], Column]] = {}


def register_operator(name: str, fn: Callable[[Column, Column], Column]) -> None:
    """A named anonymisation operator usable in ``redact(operators=...)``."""
    CUSTOM_OPERATORS[name] = fn


@dataclass
class ScanSettings:
    """Scan settings (threshold None means 'default', 0.0 is honoured)."""
    threshold: float | None = 0.7
    entities: list[str] | None = None
    method: str = "replace"
    operators: dict[str, str] = field(default_factory=dict)
    max_file_bytes: int = 100 * 1024 * 1024
    min_tier: int = 1
    extensions: list[str] | None = None

    def effective_threshold(self, default: float = 0.7) -> float:
        return default if self.threshold is None else self.threshold
