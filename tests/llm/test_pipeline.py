"""Each stage on its own input against plain versions."""

import corpus_pipeline
from test_containment import plain_leaks
from test_lines import plain_dedup
from test_packing import check_sequences, expected_pieces
from test_simhash import plain_components, plain_fingerprint
from tokenizers import Tokenizer

from lumenrank.llm import quality, registry, tokens

SF = "/root/testdata/sf0.001"


def pairs(df):
    return sorted([(r.doc_id, r.text) for r in df.collect()], key=repr)


def test_stages(spark):
    docs = registry.documents(spark, SF)
    stages, columns = dict(corpus_pipeline.STAGES), docs.columns
    kept = {r.doc_id for r in quality.op1_quality_rules(spark, SF).filter("kept").collect()}

    good = corpus_pipeline.materialise(stages["quality_rules"](spark, docs, SF))
    assert good.columns == columns and pairs(good) == [p for p in pairs(docs) if p[0] in kept]

    deduped = corpus_pipeline.materialise(stages["line_dedup"](spark, good, SF))
    assert deduped.columns == columns and pairs(deduped) == plain_dedup(pairs(good))

    single = corpus_pipeline.materialise(stages["near_dedup"](spark, deduped, SF))
    fps = {i: plain_fingerprint(t) for i, t in pairs(deduped)}
    roots, least = plain_components(set(fps.values())), {}
    for i, f in fps.items():
        least[roots[f]] = min(i, least.get(roots[f], i))
    assert single.columns == columns and pairs(single) == [p for p in pairs(deduped) if p[0] in least.values()]

    clean = corpus_pipeline.materialise(stages["decontamination"](spark, single, SF))
    leaky = {d for d, *_ in plain_leaks(pairs(single), [(r.item_id, r.text) for r in registry.benchmark(spark, SF).collect()])}
    assert clean.columns == columns and pairs(clean) == [p for p in pairs(single) if p[0] not in leaky]

    packed = stages["packing"](spark, clean, SF).collect()
    tokenizer = Tokenizer.from_file(tokens.default_vocabulary())
    assert sorted([tuple(r)[:5] for r in packed], key=repr) == expected_pieces(tokenizer, pairs(clean))
    check_sequences(packed)


def test_run_equals_the_stages(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert len({(r.doc_id, r.piece) for r in rows}) == len(rows) > 100
    check_sequences(rows)


def test_empty_table(spark):
    docs = registry.documents(spark, SF).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.collect() == []


def test_clashing_columns_stay(docs, spark):
    table = docs([(1, "the of and w1 w2 w3 to in an it " * 3 + " ".join(f"the q{i} of" for i in range(40))), (2, None)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, table, SF).columns == table.columns, name
