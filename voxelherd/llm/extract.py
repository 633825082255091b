"""Main text of HTML pages by a linear-chain conditional random field over leaf blocks.

Each page is read into leaf blocks (see ``pages``) that a chain (see ``crf``) labels as main
text or not: from the names of the elements around a block, from its text, place and
neighbours, and from the label of the block before, more strongly within one element. The
model is trained on labelled pages, ``(html, lines of the main text)``. By default these are
``TRAINING_PAGES`` pages of many layouts made by ``layouts``, so a page has the same result
in whatever table it stands. Training takes place on the driver, on that bounded number of
pages; extraction is map only.

Defined results: a null or empty page and a page without main text give an empty text; ties
of the chain go to what is not main text; repeated rows keep their rows; an empty table gives
no rows; further columns are kept.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from voxelherd.llm import crf
from voxelherd.llm.crf import Chain
from voxelherd.llm.layouts import labelled_page
from voxelherd.llm.pages import Block, leaf_blocks, same_place

# Labelled pages that the default model is trained on.
TRAINING_PAGES = 1200


def _kinds(blocks: Sequence[Block]) -> list[int]:
    return [same_place(a, b) for a, b in zip(blocks, blocks[1:])]


def align(blocks: Sequence[Block], lines: Iterable[str]) -> list[int]:
    """1 for each block that is a line of the main text; a line repeated is as often main text, in order."""
    left = Counter(lines)
    labels = []
    for block in blocks:
        labels.append(int(left[block.text] > 0))
        left[block.text] -= labels[-1]
    return labels


def fit(labelled: Iterable[tuple[str, Sequence[str]]]) -> Chain:
    """Train on labelled pages: the page and the lines of its main text."""
    pages = [(leaf_blocks(html), lines) for html, lines in labelled]
    items = [[[*block.local, *block.element.names, *block.element.near] for block in blocks] for blocks, _ in pages]
    return crf.train(items, [_kinds(blocks) for blocks, _ in pages], [align(*page) for page in pages])


@lru_cache(maxsize=1)
def default_model() -> Chain:
    """The chain trained on the made pages."""
    return fit(labelled_page(seed) for seed in range(TRAINING_PAGES))


def main_blocks(html: str, model: Chain) -> list[str]:
    """Texts of the blocks that are main text, in the order of the page."""
    weights = model.weights
    blocks = leaf_blocks(html, weights)
    around: dict[tuple, float] = {}
    scores = []
    for block in blocks:
        called = (block.element.names, block.element.near)
        if called not in around:
            around[called] = sum(weights[name] for part in called for name in part)
        scores.append(around[called] + sum(weights.get(name, 0.0) for name in block.local))
    labels = crf.decode(model, scores, _kinds(blocks))
    return [block.text for block, label in zip(blocks, labels) if label]


def extract_text(pages: DataFrame, model: Chain | None = None, html: str = "html", into: str = "main_text") -> DataFrame:
    """Pages with their main text in ``into``, blocks joined by line breaks."""
    model = model or default_model()
    shared = pages.sparkSession.sparkContext.broadcast(model)
    names = pages.columns
    where = names.index(html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for batch in batches:
            texts = ["\n".join(main_blocks(page, chain)) if page else "" for page in batch.column(where).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, into])

    return pages.mapInArrow(run, StructType([*pages.schema.fields]).add(into, "string"))
