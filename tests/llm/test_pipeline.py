import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline


def test_stages_against_plain_versions(spark, folder, prose):
    """Every stage on all that the one before it kept, held against what a plain reading of the documents gives."""
    good = {i: prose(i, 80).capitalize() + "." for i in range(150)}
    junk = {i: " | ".join(prose(i, 80).split()) for i in range(200, 350)}
    items = [(i, prose(900 + i, 30).capitalize() + ".") for i in range(10)]
    copies = {400: good[3], 401: good[3] + " tail", 402: good[7].upper().lower().capitalize()}
    leaks = {500 + i: prose(700 + i, 40).capitalize() + ". " + items[i][1] + " " + prose(800 + i, 30).capitalize() + "." for i in range(10)}
    mails = {600: prose(950, 60).capitalize() + ". a.b@c.example.org now."}
    texts = good | junk | copies | leaks | mails
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()] + [(700, None, "en", "s", 0), (701, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i in good] + [(i, 0, 0) for i in junk]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    docs, kept, columns = spark.read.parquet(f"{folder}/documents.parquet"), {}, None
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        kept[name] = {r.doc_id: r for r in docs.collect()}
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns

    first = set(kept["quality_classifier"])
    assert not first & set(junk) and set(good) | set(copies) | set(leaks) | set(mails) <= first
    second = set(kept["minhash_near_dedup"])
    assert first - second == set(copies)
    third = set(kept["benchmark_decontamination"])
    assert second - third == set(leaks)
    fourth = kept["pii"]
    assert set(fourth) == third
    assert fourth[600].text == mails[600].replace("a.b@c.example.org", "[EMAIL]") and fourth[600].n_chars == len(fourth[600].text)
    assert all(fourth[i].text == good[i] for i in good)
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = docs.toPandas()
    size = {i: len(plain.encode(r.text or "", add_special_tokens=False).ids) + 1 for i, r in fourth.items()}
    assert packed.groupby("doc_id").length.sum().to_dict() == size
    assert (packed.groupby("sequence_id").length.sum() <= 1024).all()
    assert packed.sequence_id.nunique() <= -(-sum(size.values()) // 1024) + 1

    whole = corpus_pipeline.run(spark, folder).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole[key].values.tolist())) == sorted(map(tuple, packed[key].values.tolist()))
