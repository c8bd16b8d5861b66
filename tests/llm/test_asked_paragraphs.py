"""Paragraphs asked of texts: those that a text under the same id does not have are left out."""

import pyarrow as pa

from duskwatch.llm import paragraphs


def test_texts_without_the_asked_paragraph():
    texts = ["One two three four five six seven eight nine.", "Nothing here.", "Ten eleven twelve thirteen fourteen fifteen sixteen.\n" * 2]
    rows = [r for b in [pa.RecordBatch.from_arrays([pa.array([0, 1, 2], pa.int64()), pa.array(texts)], ["doc_id", "text"])] for r in next(paragraphs._listed(5)([b])).to_pylist()]
    asked = [[{"paragraph": r["paragraph"], "content": r["content"]} for r in rows if r["doc_id"] == k] for k in range(3)]
    kind = pa.list_(pa.struct([("paragraph", pa.int32()), ("content", pa.int64())]))
    more = [asked[0] + asked[2], asked[0], asked[2]]  # the second text has none of the first's, the first not the third's
    got = [r for b in paragraphs._shingles(False)([pa.RecordBatch.from_arrays([pa.array(texts), pa.array(more, kind)], ["text", "asked"])]) for r in b.to_pylist()]
    assert [r["id"] for r in got] == [x["content"] for x in asked[0] + asked[2]]
    assert [len(r["hashes"]) // 8 for r in got] == [5, 3, 3]
