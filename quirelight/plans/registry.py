"""Stages from one format to another, chained by the shortest way."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame

from quirelight.exceptions import ConversionError
from quirelight.operators import bio, convert, words

Stage = Callable[[DataFrame], DataFrame]


class Registry:
    """Converters between named formats."""

    def __init__(self) -> None:
        self.stages: dict[tuple[str, str], Stage] = {}

    def converter(self, source: str, target: str) -> Callable[[Stage], Stage]:
        """Decorator that registers a stage."""

        def add(stage: Stage) -> Stage:
            self.stages[source, target] = stage
            return stage

        return add

    def way(self, source: str, target: str) -> list[Stage]:
        """The stages from one format to the other, the fewest; an error where there are none."""
        back: dict[str, str | None] = {source: None}
        queue = deque([source])
        while queue and target not in back:
            at = queue.popleft()
            for a, b in sorted(self.stages):
                if a == at and b not in back:
                    back[b] = at
                    queue.append(b)
        if target not in back:
            raise ConversionError(f"no way from {source} to {target}")
        out = []
        while (before := back[target]) is not None:
            out.append(self.stages[before, target])
            target = before
        return out[::-1]

    def convert(self, df: DataFrame, source: str, target: str) -> DataFrame:
        for stage in self.way(source, target):
            df = df.transform(stage)
        return df


def converters() -> Registry:
    """The engine's own stages: rendered or plain pages ``(doc_id, html)`` to indexed words, words to JSON or text, tags to spans and CoNLL lines."""
    out = Registry()
    out.converter("rendered", "words")(convert.positioned)
    out.converter("html", "words")(convert.plain_html)
    out.converter("words", "json")(words.document_json)
    out.converter("words", "text")(words.plain_text)
    out.converter("bioul", "bio")(bio.bioul_to_bio)
    out.converter("bio", "spans")(lambda tokens: bio.spans(tokens, "bio"))
    out.converter("spans", "parts")(bio.structured_spans)
    return out
