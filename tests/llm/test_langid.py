import zlib

from pyspark.sql import functions as F

from loomspan.llm import langid


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = langid.op10_language_id(spark, sf)
    truth = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("i"), "lang")
    rows = got.join(truth, got.doc_id == truth.i).toPandas()
    assert rows.held_out.tolist() == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id]
    assert (rows.lang_pred == rows.lang)[rows.held_out].mean() > 0.98
    assert rows.score.between(0, 1).all()


def test_edges(spark, make_docs):
    train = make_docs(["the cat sat on the mat and the dog ran off " * 5, "der hund lief über die straße und die katze schlief " * 5, None, "x y z"]).withColumn("lang", F.when(F.col("doc_id") == 0, "en").when(F.col("doc_id") == 1, "de").when(F.col("doc_id") == 2, "fr"))
    dictionaries = langid.train_dictionaries(train)
    assert sorted(dictionaries) == ["de", "en"]
    some = ["the dog sat on the cat", "DIE KATZE LIEF ÜBER DIE STRASSE", None, "", "123 !?", "\n\t", "the cat sat " * 20_000, "q"]
    docs = make_docs(some).withColumns({"score": F.lit("clash"), "lang_pred": F.lit("clash"), "rejected": F.lit(7)})
    docs = docs.unionByName(docs.where("doc_id = 0"))
    rows = langid.identify(docs, dictionaries).collect()
    assert len(rows) == len(some) + 1
    got = {r.doc_id: r for r in rows}
    assert [got[i].lang_pred for i in range(7)] == ["en", "de", "und", "und", "und", "und", "en"]
    assert got[7].lang_pred == "de" and got[7].rejected  # a tie: the least by code point, margin 0
    assert got[2].rejected and got[2].score == 0 and not got[0].rejected and got[0].source == "s0"
    assert langid.train_dictionaries(train.limit(0)) == {}
    assert [r.lang_pred for r in langid.identify(docs.where("doc_id = 0"), {}).collect()] == ["und", "und"]
    assert langid.identify(docs.limit(0), dictionaries).count() == 0


def test_sample_is_bounded(spark, make_docs):
    docs = make_docs([f"text number {i} " * 50 for i in range(2000)])
    found = langid.train_dictionaries(docs, sample_docs=8, dict_bytes=1000)
    assert len(found["en"]) <= 1000
    assert found == langid.train_dictionaries(docs.repartition(7), sample_docs=8, dict_bytes=1000)


def test_against_a_plain_version(spark, sf_dir):
    """The query over the whole table: dictionaries and predictions as a plain loop over rows finds them."""
    import zstandard

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.collect()
    dictionaries = langid.train_dictionaries(docs.where(~langid.held_out("doc_id")))
    assert set(dictionaries) == {r.lang for r in rows if r.lang}
    for lang, content in dictionaries.items():
        own = "\n".join(r.text.lower() for r in rows if r.lang == lang and r.text and zlib.crc32(str(r.doc_id).encode()) % 5).encode()
        assert len(content) <= langid.DICT_BYTES and all(part in own for part in content.split(b"\n") if len(part) > 40)

    def size(text, content):
        data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=langid.LEVEL)
        press = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)
        raw = text.lower().encode()
        return sum(len(press.compress(raw[k : k + langid.BLOCK_BYTES])) for k in range(0, len(raw), langid.BLOCK_BYTES))

    got = {r.doc_id: r for r in langid.op10_language_id(spark, sf_dir).collect()}
    for r in rows:
        found = got[r.doc_id]
        if not r.text or not any(c.isalpha() for c in r.text):
            assert (found.lang_pred, found.score, found.rejected) == ("und", 0.0, True)
            continue
        (least, lang), (second, _) = sorted((size(r.text, content), lang) for lang, content in dictionaries.items())[:2]
        assert found.lang_pred == lang and found.rejected == ((second - least) / least < langid.REJECT_MARGIN)


def test_many_languages_share_the_bound(spark, monkeypatch):
    monkeypatch.setattr(langid, "ALL_DICT_BYTES", 64 << 10)
    docs = spark.createDataFrame([(k, f"words of language {k} " * 200, f"l{k % 40}") for k in range(400)], "doc_id long, text string, lang string")
    found = langid.train_dictionaries(docs)
    assert len(found) == 40 and sum(map(len, found.values())) <= 64 << 10
