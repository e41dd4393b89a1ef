"""All stages on a small folder: nulls, repeated rows, foreign columns, an
empty table."""

import random

import corpus_pipeline


def folder(llm, root, docs):
    schema = "doc_id bigint, text string, lang string, source string, n_chars string"
    llm.createDataFrame(docs, schema).write.parquet(f"{root}/documents.parquet")
    llm.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id bigint, quality int, toxic int").where(
        "doc_id < 0" if not docs else "true").write.parquet(f"{root}/labels.parquet")
    llm.createDataFrame([(1, " ".join(f"answer{i}" for i in range(30)))], "item_id bigint, text string").write.parquet(
        f"{root}/benchmark.parquet")
    return str(root)


def test_stages_take_effect(llm, tmp_path):
    rnd = random.Random(1)
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(80)), "en", "s", "x") for i in range(60)]
    near = docs[5][1].replace(docs[5][1].split()[40], "changed", 1)
    docs += [(100, docs[3][1], "en", "s", None), (101, near, "en", "s", "1"), docs[7], (102, None, "en", "s", "1"), (103, "", None, None, "1"),
             (104, "12 34", None, "s", "1"), (105, docs[9][1] + " " + " ".join(f"answer{i}" for i in range(30)), "en", "s", "1")]
    rows = corpus_pipeline.run(llm, folder(llm, tmp_path, docs)).collect()
    kept = {r.doc_id for r in rows}
    assert kept >= set(range(60)) and not kept & {100, 102, 103, 104, 105}
    assert sum(r.length for r in rows if r.doc_id == 7) == rows[[r.doc_id for r in rows].index(7)].doc_tokens   # one of the repeats
    assert {r.sequence_id for r in rows} and all(r.offset + r.length <= 1024 for r in rows)
    from fleetlane.session import checkpoint_root
    import glob
    left = [p for p in glob.glob(checkpoint_root(llm).removeprefix("file://") + "/pipeline-*")]
    assert len([p for p in left if "packing" not in p]) == 0     # inputs of later stages are gone


def test_empty_documents(llm, tmp_path):
    assert corpus_pipeline.run(llm, folder(llm, tmp_path, [])).count() == 0
