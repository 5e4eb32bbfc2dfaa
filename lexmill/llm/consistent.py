"""The consistent form of docs.text, tasks.answer and tasks.aliases, beside the repair of wrong encodings.

A docs record whose title or text was decoded wrongly is another problem's case: its text is repaired first and does not
count as changed. Each table is read once for the model and once for the forms; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import encoding
from lexmill.llm.charmodel import CharModel, train
from lexmill.llm.lookalikes import Consistent

_FORMS = "tbl string, row_key string, field string, place int, form string, changed boolean"
_NAMES = ["tbl", "row_key", "field", "place", "form", "changed"]


def consistent_forms(docs: DataFrame, tasks: DataFrame) -> DataFrame:
    """(tbl, row_key, field, place, form, changed): one row for each value; place counts within aliases, else it is 0."""
    repairer = encoding.fit(docs, "ord", ["text", "title"])
    named = tasks.select(F.explode(F.concat(F.array("answer"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("value")).where("value is not null")
    more, _ = train(named, encoding.clean_words)
    model = CharModel.joined(repairer.model, more)
    shared = docs.sparkSession.sparkContext.broadcast((repairer.model, repairer.margins, model))

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair, forms = encoding.Repairer(*shared.value[:2]), Consistent(shared.value[2])
        for batch in batches:
            keys, titles, texts = (c.to_pylist() for c in batch.columns)
            damaged = [a for a, _ in repair.repair_all(titles)]
            rows = []
            for key, title_bad, text, (text_bad, restored) in zip(keys, damaged, texts, repair.repair_all(texts)):
                if text is not None:
                    form = forms.form(restored)
                    rows.append(("docs", str(key), "text", 0, form, form != text and not (title_bad or text_bad)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)] if rows else [pa.array([], t) for t in _TYPES], names=_NAMES)

    def of_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms = Consistent(shared.value[2])
        for batch in batches:
            rows = []
            for key, answer, aliases in zip(*(c.to_pylist() for c in batch.columns)):
                for field, values in (("answer", [answer]), ("aliases", aliases or [])):
                    for place, value in enumerate(values):
                        if value is not None:
                            form = forms.form(value)
                            rows.append(("tasks", key, field, place, form, form != value))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)] if rows else [pa.array([], t) for t in _TYPES], names=_NAMES)

    first = docs.select(F.col("ord").cast("string"), F.col("title").cast("string"), F.col("text").cast("string")).mapInArrow(of_docs, _FORMS)
    return first.union(tasks.select("task_id", "answer", "aliases").mapInArrow(of_tasks, _FORMS))


_TYPES = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.bool_()]
