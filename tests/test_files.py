import pytest
from pyspark.sql import functions as F

from seqsieve.sources import files
from seqsieve.streaming.counts import running_counts, windowed_counts


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


@pytest.fixture
def asvs(spark, tmp_path):
    path = put(tmp_path, "a.fasta", ">u1;size=5 first one\nACG\nTT\n>u2;size=3\r\nGGG\r\n\n>u3;size=1\nTTT\n")
    return files.numbered(files.read_fasta(spark, path))


def test_fasta(spark, asvs):
    rows = asvs.orderBy("asv_ord").collect()
    assert [(r.asv_ord, r.asv_id, r.asv_key, r.seq, r.len) for r in rows] == [(0, "u1;size=5", "u1", "ACGTT", 5), (1, "u2;size=3", "u2", "GGG", 3), (2, "u3;size=1", "u3", "TTT", 3)]
    assert rows[0].header == "u1;size=5 first one" and not files.is_aligned(asvs)
    assert files.is_aligned(asvs.filter("asv_ord > 0"))
    with pytest.raises(files.FormatError):
        files.check_unique(asvs.union(asvs), "asv_id")
    assert [r.value for r in files.fasta_lines(asvs).collect()][1] == ">u2;size=3\nGGG"


@pytest.mark.parametrize("sep", [",", "\t"])
@pytest.mark.parametrize("corner", [True, False])
@pytest.mark.parametrize("across", [True, False])
@pytest.mark.parametrize("tagged", [True, False])
def test_count_tables(spark, tmp_path, asvs, sep, corner, across, tagged):
    names = ["u1;size=5", "u2;size=3", "u3;size=1"] if tagged else ["u1", "u2", "u3"]
    libs, n = ["T1", "T2"], {("T1", 0): 4, ("T2", 0): 1, ("T2", 1): 3, ("T1", 2): 1}
    heads, rows = (names, libs) if across else (libs, names)
    lines = [sep.join((["#id"] if corner else []) + heads)]
    for i, r in enumerate(rows):
        lines.append(sep.join([r] + [str(n.get((r, j) if across else (h, i), 0)) for j, h in enumerate(heads)]))
    path = put(tmp_path, f"m{hash((sep, corner, across, tagged))}.txt", "\n".join(lines) + "\n")
    got = {(r.library, r.asv_id): r.n for r in files.read_counts(spark, path, asvs).collect()}
    full = ["u1;size=5", "u2;size=3", "u3;size=1"]
    assert got == {(lib, full[i]): k for (lib, i), k in n.items()}


def test_bad_count_tables(spark, tmp_path, asvs):
    for i, text in enumerate(["a b\n", "x,T1,T2\nu1,1\nu2,1,2\n", "x,T1,T1\nu1,1,2\n"]):
        with pytest.raises(files.FormatError):
            files.read_counts(spark, put(tmp_path, f"bad{i}.csv", text), asvs).collect()


def test_reads(spark, tmp_path, asvs):
    a = put(tmp_path, "T1.fasta", ">r1\nacgtt\n>r2\nGGG\n>r3\nCCC\n")
    b = put(tmp_path, "T2.fastq", "@r1\nGGG\n+\n!!!\n@r2\nTTT\n+\n@@@\n")
    assert files.sniff(spark, a) == "fasta" and files.sniff(spark, b) == "fastq"
    got = sorted((r.library, r.asv_id) for r in files.match_reads(files.read_reads(spark, [a, b]), asvs).collect())
    assert got == [("T1", "u1;size=5"), ("T1", "u2;size=3"), ("T2", "u2;size=3"), ("T2", "u3;size=1")]
    one = put(tmp_path, "all.fasta", ">r1;sample=S1;\nGGG\n>r2;barcodelabel=S2;\nGGG\n>r3\nCCC\n")
    assert sorted(r.library for r in files.match_reads(files.read_reads(spark, [one]), asvs).collect()) == ["S1", "S2"]
    nameless = put(tmp_path, "none.fasta", ">r1\nGGG\n")
    with pytest.raises(Exception, match="names no library"):
        files.match_reads(files.read_reads(spark, [nameless]), asvs).collect()
    with pytest.raises(files.FormatError):
        files.sniff(spark, put(tmp_path, "x.txt", "hello\n"))


def test_taxa_and_store(spark, tmp_path, asvs):
    good = put(tmp_path, "t.csv", "u1;size=5,A\nu2;size=3,B\nu3;size=1,A\n")
    assert files.read_taxa(spark, good, asvs).count() == 3
    with pytest.raises(files.FormatError):
        files.read_taxa(spark, put(tmp_path, "t2.csv", "u1;size=5,A\n"), asvs)
    store = put(tmp_path, "s.tsv", "0\treject\tu1;size=5\n3\tretain\tu2;size=3\tu3;size=1\n4\treject\n")
    rows = {r.resultindex: (r.action, r.asv_ids) for r in files.read_store(spark, store).collect()}
    assert rows == {0: ("reject", ["u1;size=5"]), 3: ("retain", ["u2;size=3", "u3;size=1"]), 4: ("reject", [])}
    with pytest.raises(files.FormatError):
        files.read_store(spark, put(tmp_path, "s2.tsv", "x\tdrop\n"))
    files.write_store(files.read_store(spark, store), str(tmp_path / "out"))
    assert files.read_store(spark, str(tmp_path / "out")).count() == 3


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("r1;sample=A;", "x", "2024-01-01 00:10:00"), ("r2;sample=A;", "x", "2024-01-01 00:20:00"), ("r3;sample=B;", "y", "2024-01-01 02:00:00"), ("r4", "y", "2024-01-01 02:00:00")], "header string, asv_id string, ts string").withColumn("ts", F.to_timestamp("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("plain", running_counts(stream), "complete"), ("windowed", windowed_counts(stream), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert {tuple(r) for r in spark.table("plain").collect()} == {("A", "x", 2), ("B", "y", 1)}
    assert {(r.library, r.asv_id, r.n) for r in spark.table("windowed").collect()} >= {("A", "x", 2)}
