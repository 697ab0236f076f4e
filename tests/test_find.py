"""The whole search on files, and the command line."""

import random

import pytest
from pyspark.sql import functions as F

from seqsieve.jobs import cli
from seqsieve.jobs import find as jobs
from seqsieve.operators import controls
from seqsieve.sources import files


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """30 sequences of three families, without stops in frame 2 but for the last two; the first three are references."""
    rnd, d = random.Random(1), tmp_path_factory.mktemp("data")
    codons = [a + b + c for a in "ACG" for b in "ACGT" for c in "ACG"]
    base = ["C" + "".join(rnd.choices(codons, k=30)) for _ in range(3)]
    seqs = []
    for i in range(30):
        s = list(base[i % 3])
        s[rnd.randrange(1, 90)] = rnd.choice("ACG")
        seqs.append("".join(s) + "G" * (i // 3 % 2 and i % 3 == 1) if i < 27 else "".join(s))
    seqs = list(dict.fromkeys(seqs))
    seqs += ["C" + "TAA" * 30, "C" + "TAG" * 30, "ACG" * 9]
    names = [f"u{i};size={100 - i}" for i in range(len(seqs))]
    (d / "asvs.fasta").write_text("".join(f">{n} some text\n{s[:40]}\n{s[40:]}\n" for n, s in zip(names, seqs, strict=True)))
    (d / "refs.fasta").write_text("".join(f">r{i}\n{s.lower()}\n" for i, s in enumerate(seqs[:3])))
    table = {(lib, i): rnd.randint(0, 30) for lib in ("T1", "T11", "T2") for i in range(len(seqs))}
    (d / "counts.tsv").write_text("\t".join(["T1", "T11", "T2"]) + "\n" + "".join("\t".join([n.split(";")[0], *(str(table[lib, i]) for lib in ("T1", "T11", "T2"))]) + "\n" for i, n in enumerate(names)))
    (d / "taxa.csv").write_text("".join(f"{n},{'AB'[i % 2]}\n" for i, n in enumerate(names)))
    (d / "specs.txt").write_text("# all\n[library; n; 3-20/5]\n+ [library|taxon; p; 0.05,0.1] * [total; n; 10,40]\n")
    return d, names, seqs, table


def test_find_and_dump(spark, folder):
    d, names, seqs, table = folder
    inputs = jobs.load(spark, str(d / "asvs.fasta"), readmap=str(d / "counts.tsv"), taxa=str(d / "taxa.csv"))
    refs = files.read_fasta(spark, str(d / "refs.fasta")).select(F.col("asv_id").alias("ref_id"), F.upper("seq").alias("ref_seq"))
    tagged = jobs.find_controls(inputs, refs, (80, 100), frame=2)
    reasons = {(r.asv_id, r.reason) for r in tagged.collect()}
    n = len(names)
    assert {(names[0], "refpass"), (names[1], "refpass"), (names[2], "refpass"), (names[n - 3], "stopfail"), (names[n - 2], "stopfail"), (names[n - 1], "lengthfail")} <= reasons
    results, scored, grid = jobs.find(inputs, tagged, (d / "specs.txt").read_text())
    rows = results.orderBy("resultindex").collect()
    assert len(rows) == 5 + 4 and rows[5].term == "library|taxon_p*total_n"
    bad, good = {names[i] for i in range(n - 3, n)}, {a for a, r in reasons if r == "refpass"}
    t = rows[2]["library_n_threshold"]
    low = {names[i] for i in range(n) if any(table[lib, i] for lib in ("T1", "T11", "T2")) and max(table[lib, i] for lib in ("T1", "T11", "T2")) < t}
    assert rows[2].asvsactual_rejected_n == len((low | bad) - good)
    store = jobs.store_of(scored, grid, [2, 5])
    kept = {r.asv_id for r in jobs.dump_cached(inputs.asvs, store, [2]).collect()}
    assert kept == set(names) - ((low | bad) - good)
    dumped = {r.asv_id for r in jobs.dump_spec(inputs, [f"[library; n; {t}]"]).collect()}
    assert dumped == set(names) - low
    best, long = jobs.analyse(results, grid.names())
    assert best.count() >= 1 and {r.term for r in long.select("term").distinct().collect()} == {"library_n"}
    with pytest.raises(controls.ControlSetError):
        jobs.find(inputs, tagged.filter("reason = 'refpass'"), "[library; n; 3]")


def test_clades_from_sequences_and_trees(spark, folder):
    d, names, seqs, _ = folder
    keep = [i for i, s in enumerate(seqs) if len(s) == 91]
    (d / "even.fasta").write_text("".join(f">{names[i]}\n{seqs[i]}\n" for i in keep))
    taxa = d / "none.csv"
    taxa.write_text("")
    inputs = jobs.load(spark, str(d / "even.fasta"), readmap=str(d / "counts.tsv"), want_clades=True)
    groups = {}
    for r in inputs.groups["clade"].collect():
        groups.setdefault(r.group_id, set()).add(r.asv_id)
    assert len(groups) >= 3 and sum(map(len, groups.values())) == len(keep)
    tree = d / "t.nwk"
    tree.write_text("((u0-size=100:0.05,u1-size=99:0.05):0.3,u2-size=98:0.35);")
    cut = jobs.load(spark, str(d / "asvs.fasta"), readmap=str(d / "counts.tsv"), tree=str(tree)).groups["clade"].collect()
    assert {(r.group_id, r.asv_id) for r in cut} == {("1", names[0]), ("1", names[1]), ("2", names[2])}
    with pytest.raises(files.FormatError):
        jobs.load(spark, str(d / "asvs.fasta"), readmap=str(d / "counts.tsv"), want_clades=True)
    with pytest.raises(ValueError):
        jobs.load(spark, str(d / "asvs.fasta"))


def test_command_line(spark, folder, tmp_path):
    d, names, seqs, _ = folder
    common = ["--asvs", str(d / "asvs.fasta"), "--readmap", str(d / "counts.tsv"), "--taxa", str(d / "taxa.csv")]
    cli.main(["find", *common, "--specification", str(d / "specs.txt"), "--references", str(d / "refs.fasta"), "--minimum", "80", "--maximum", "100", "--frame", "2", "--output", str(tmp_path / "out")], spark)
    assert spark.read.csv(str(tmp_path / "out/results"), header=True).count() == 9
    assert spark.read.parquet(str(tmp_path / "out/store")).count() >= 1
    cli.main(["find", *common, "--specification", str(d / "specs.txt"), "--controls", str(tmp_path / "out/controls"), "--minimum", "80", "--output", str(tmp_path / "again")], spark)
    results = lambda at: sorted(map(tuple, spark.read.csv(str(tmp_path / at / "results"), header=True).collect()))
    assert results("out") == results("again")
    rows = spark.read.parquet(str(tmp_path / "out/hashes")).collect()
    index = spark.read.parquet(str(tmp_path / "out/store")).first().resultindex
    twin = max(r.resultindex for r in rows if r.rejects_hash == next(x.rejects_hash for x in rows if x.resultindex == index))
    cli.main(["dump", "--asvs", str(d / "asvs.fasta"), "--store", str(tmp_path / "out/store"), "--hashes", str(tmp_path / "out/hashes"), "--index", str(twin), "--output", str(tmp_path / "cached")], spark)
    assert spark.read.text(str(tmp_path / "cached")).filter("value like '>%'").count() > 0
    cli.main(["dump", *common, "--specification", "[library; n; 5]", "--output", str(tmp_path / "kept")], spark)
    assert spark.read.text(str(tmp_path / "kept")).filter("value like '>%'").count() > 0
    cli.main(["translate", "--asvs", str(d / "asvs.fasta"), "--frame", "2", "--output", str(tmp_path / "tr")], spark)
    assert spark.read.text(str(tmp_path / "tr/fail")).filter("value like '>%'").count() == 2
    cli.main(["length", "--asvs", str(d / "asvs.fasta"), "--minimum", "50", "--output", str(tmp_path / "len")], spark)
    assert spark.read.text(str(tmp_path / "len/fail")).filter("value like '>%'").count() == 1


def test_resuming(spark, folder, tmp_path, monkeypatch):
    """Controls and clades of a run are read by the next; a changed option or input isn't."""
    d, *_ = folder
    made = []
    for module, name in ((jobs, "find_controls"), (jobs.linkage, "linkage")):
        monkeypatch.setattr(module, name, lambda *a, own=getattr(module, name), n=name, **k: made.append(n) or own(*a, **k))
    width = "".join(line for line in (d / "asvs.fasta").read_text())
    rows = [r.partition("\n") for r in width.split(">")[1:]]
    (tmp_path / "aligned.fasta").write_text("".join(f">{h}\n{b.replace(chr(10), '').ljust(100, '-')}\n" for h, _, b in rows))
    (tmp_path / "specs.txt").write_text("[library|clade; p; 0.05,0.1]")

    def run(out, *more):
        made.clear()
        cli.main(["find", "--asvs", str(tmp_path / "aligned.fasta"), "--readmap", str(d / "counts.tsv"), "--specification", str(tmp_path / "specs.txt"), "--references", str(d / "refs.fasta"), "--minimum", "80", "--maximum", "100", "--frame", "2", "--keep", str(tmp_path / "keep"), "--output", str(tmp_path / out), *more], spark)
        return sorted(made), sorted(map(tuple, spark.read.csv(str(tmp_path / out / "results"), header=True).collect()))

    first = run("a")
    assert first[0] == ["find_controls", "linkage"]
    assert run("b") == ([], first[1])
    assert run("c", "--divergence", "0.1")[0] == ["linkage"]
    assert run("e", "--least-match", "70")[0] == ["find_controls"]
