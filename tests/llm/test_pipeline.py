import corpus_pipeline
from tests.llm.test_decontamination import brute
from tests.llm.test_near_copies import brute_kept
from tests.llm.test_spans import secrets_of

from pulsegrid.llm import bpe, toxicity
from pulsegrid.llm.common import table


def test_stages_against_brute_force(spark, sf, tmp_path):
    docs = table(spark, sf, "documents")
    columns, kept = docs.columns, {r.doc_id: r for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "decontamination", "secrets", "bpe"]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        out = {r.doc_id: r for r in docs.collect()}
        if name == "toxicity":
            model = toxicity.train_on_fold(table(spark, sf, "documents"), table(spark, sf, "labels"))
            assert out.keys() == {k for k, r in kept.items() if model.score(r.text or "") < 0.3} and len(out) < len(kept)
        elif name == "near_copies":
            assert out.keys() == brute_kept({k: r.text for k, r in kept.items()})
        elif name == "decontamination":
            items = [(str(r.item_id), r.text) for r in table(spark, sf, "benchmark").collect()]
            found = dict(zip(kept, brute([r.text for r in kept.values()], items, 13), strict=True))
            assert out.keys() == {k for k, (n, hit, _) in found.items() if not (hit and 20 * hit >= n)}
        elif name == "secrets":
            assert out.keys() == kept.keys()
            assert all(not secrets_of(r.text or "") and (r.n_chars == len(r.text)) for r in out.values())
            assert all(out[k].text == r.text for k, r in kept.items() if not secrets_of(r.text or "") and "[SECRET]" not in out[k].text)
        else:
            own = bpe.Tokenizer(bpe.load(bpe.default_path()))
            assert out.keys() == kept.keys() and all(out[k].n_tokens == len(own.encode(r.text or "")) for k, r in kept.items())
            break
        assert docs.columns == columns
        kept = out


def test_run_does_all_stages(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert 0 < len(rows) < table(spark, sf, "documents").count()
    assert len({r.doc_id for r in rows}) == len(rows)
