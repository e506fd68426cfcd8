"""Sequence functions, file formats and alignment kernels against known values and naive versions."""

import gzip
import math
import random

import pytest
from pyspark.sql import functions as F

from readloom.functions import alignment, sequence
from readloom.operators import similarity
from readloom.sources import formats


def column(spark, values, use):
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x string")
    return [r[0] for r in frame.orderBy("k").select(use(F.col("x"))).collect()]


def naive_rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_strands(spark):
    assert column(spark, ["TCGTTCGA", "", None], sequence.complement) == ["AGCAAGCT", "", None]
    assert column(spark, ["TCGTTCGA"], sequence.reverse_complement) == ["TCGAACGA"]
    kmers = ["ACG", "CGT", "TTT", "GAT"]
    assert column(spark, kmers, sequence.canonical) == [min(k, naive_rc(k)) for k in kmers]
    assert column(spark, ["ACGTA"], lambda x: sequence.push_right(x, F.lit("C"))) == ["CGTAC"]
    assert column(spark, ["ACGTA"], lambda x: sequence.push_left(x, F.lit("C"))) == ["CACGT"]


def test_windows_skip_other_letters(spark):
    rows = spark.createDataFrame([("ACGNTTA",), ("AC",), (None,)], "seq string")
    assert [(r["pos"], r["kmer"]) for r in sequence.explode_kmers(rows, 3).collect()] == [(0, "ACG"), (4, "TTA")]


def test_rotations():
    assert sequence.rotations("AAC") == ["AAC", "ACA", "CAA", "GTT", "TGT", "TTG"]
    assert sequence.rotations("AAA") == ["AAA", "TTT"]


def test_quality_trim(spark):
    rows = spark.createDataFrame([("ACGT", "II##"), ("ACGT", "####"), ("ACGT", "#III")], "seq string, qual string")
    assert [tuple(r) for r in sequence.quality_trim(rows).collect()] == [("AC", "II"), ("ACGT", "#III")]


@pytest.mark.parametrize(("other", "score"), [("ACGTACGTAC", 10), ("ACGTACGCAC", 8), ("ACGTACCGTAC", 7), ("ACGTAGTAC", 6)])
def test_global_scores(other, score):
    assert alignment.global_score("ACGTACGTAC", other, 3) == score == alignment.global_score("ACGTACGTAC", other)


def test_band_and_wildcard():
    with pytest.raises(ValueError, match="band"):
        alignment.global_score("ACGT", "A", 1)
    assert alignment.global_score("ACNT", "ACGT") == 4
    assert alignment.trailing_gaps(alignment.score_table("ACG", "ACGTT", None, 1, -1, -3), -3) == (3, 3)


def test_densities():
    assert math.isclose(alignment.poisson(10, 10), 0.12511003572113349, rel_tol=1e-12)
    assert math.isclose(alignment.poisson(100, 10), 4.8646491820674864e-63, rel_tol=1e-9)
    assert alignment.poisson(1000, 10) == 0
    assert math.isclose(sum(alignment.negative_binomial(k, 5, 9) for k in range(300)), 1, rel_tol=1e-9)
    assert math.isclose(sum(alignment.geometric(k, 3) for k in range(500)), 1, rel_tol=1e-9)


def test_mixture_finds_the_coverage():
    spectrum = {c: 5000 * alignment.poisson(c, 1.2) + 4000 * alignment.negative_binomial(c, 30, 40) + 300 * alignment.negative_binomial(c, 60, 80) for c in range(1, 120)}
    fit = alignment.Mixture(spectrum, 28)
    assert abs(fit.mean[2] - 30) < 1 and 3 <= fit.cutoff() <= 15


def naive_overlap(a, b, match, mismatch, gap):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            table[i][j] = max(table[i - 1][j - 1] + (match if a[i - 1] == b[j - 1] else mismatch), table[i - 1][j] + gap, table[i][j - 1] + gap)
    return max(0, *table[-1], *(row[-1] for row in table))


def test_overlap_scores_against_a_table():
    rng = random.Random(2)
    texts = ["", "A", *("".join(rng.choices("ACGT", k=rng.randint(1, 40))) for _ in range(40))]
    left, right = [rng.choice(texts) for _ in range(200)], [rng.choice(texts) for _ in range(200)]
    for scores in ((1, -4, -7), (1, -1, -3)):
        assert similarity.overlap_scores(left, right, *scores).tolist() == [naive_overlap(a, b, *scores) for a, b in zip(left, right, strict=True)]


def test_pair_scores_find_either_strand():
    rng = random.Random(4)
    p, q = ("".join(rng.choices("ACGT", k=60)) for _ in range(2))
    assert similarity.pair_scores([p], [q], [p], [q]).tolist() == [120]
    assert similarity.pair_scores([p], [q], [naive_rc(q)], [naive_rc(p)]).tolist() == [120]


def test_window_of_coverage(spark):
    low, high, most = similarity.first_window(100, 31, 200.0)
    assert 2 <= low < high <= most
    nodes = spark.createDataFrame([("a", 5.9), ("b", 9.0), ("c", 40.0)], "node string, avg_cov double")
    assert [r["node"] for r in similarity.within_window(nodes, 4, 9).collect()] == ["a"]
    members = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "pair_id long, node string")
    assert similarity.coverage_window(nodes, members, 4.0, 7.0, 12.0) == (4.0, 12.0)
    assert similarity.coverage_window(nodes, members.filter("pair_id < 3"), 4.0, 7.0, 12.0) == (4.0, 10.0)


FASTA = "junk\n>one\n" + "A" * 60 + "\n" + "C" * 60 + "\n>two x\nACGT\n"
FASTQ = "@r1\nACGT\n+\nIIII\n@r1\nacgg\n+\n@#I#\n@r2\nAC\n+\nII\n"
SAM = "@HD\tVN:1\nq1\t0\tchr\t5\t60\t4M\t*\t0\t0\tACGT\tIIII\tNM:i:0\tXX:Z:a\nq2\t16\tchr\t9\t60\t3M\t*\t0\t0\tGGT\tIII\n"


def test_folders_of_split_files_give_every_record_once(spark, tmp_path):
    rng = random.Random(1)
    folder, expected, raw = tmp_path / "reads.fastq", [], []
    folder.mkdir()
    for f in range(4):
        # qualities may begin with the sign of a header; files end with a read that has no mate
        records = [(f"f{f}r{i // 2}", "".join(rng.choices("ACGT", k=rng.randint(1, 40))), "@" + "".join(rng.choices("@+#I", k=9))) for i in range(2 * (30 + f) + 1)]
        (folder / f"{f}.fastq").write_text("".join(f"@{i}\n{s}\n+\n{q}\n" for i, s, q in records))
        expected += records
    (tmp_path / "fa.fasta").mkdir()
    for f in range(3):
        (tmp_path / "fa.fasta" / f"{f}.fasta").write_text("junk\n" * f + "".join(f">{f}-{i}\n{'ACGT' * 5}\n{'TT' * i}\n" for i in range(20)))
    whole = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "256b")
        assert formats.numbered_parts(spark, str(folder)).select("file").count() == 4 * len(expected)
        assert spark.read.text(str(folder)).rdd.getNumPartitions() > 10
        found = formats.read_fastq(spark, str(folder)).orderBy("idx").collect()
        pairs = formats.read_pairs(spark, str(folder)).orderBy("pair_id").collect()
        fasta = formats.read_fasta(spark, str(tmp_path / "fa.fasta")).orderBy("idx").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", whole)
    assert [(r["id"], r["seq"], r["qual"]) for r in found] == expected and [r["idx"] for r in found] == list(range(len(expected)))
    assert [r["pair_id"] for r in pairs] == list(range(1, 127)) and [r["id"] for r in pairs] == [f"f{f}r{i}" for f in range(4) for i in range(30 + f)]
    assert [(r["id"], len(r["seq"])) for r in fasta] == [(f"{f}-{i}", 20 + 2 * i) for f in range(3) for i in range(20)]


@pytest.mark.parametrize("zipped", [False, True])
def test_readers(spark, tmp_path, zipped):
    def put(name, text):
        path = tmp_path / (name + (".gz" if zipped else ""))
        path.write_bytes(gzip.compress(text.encode()) if zipped else text.encode())
        return str(path)

    fasta = formats.read_sequences(spark, put("a.FASTA", FASTA)).orderBy("idx").collect()
    assert [(r["id"], r["seq"]) for r in fasta] == [("one", "A" * 60 + "C" * 60), ("two x", "ACGT")]
    path = put("b.fastq", FASTQ)
    fastq = formats.read_sequences(spark, path).orderBy("idx").collect()
    assert [tuple(r) for r in fastq] == [(0, "r1", "ACGT", "IIII"), (1, "r1", "acgg", "@#I#"), (2, "r2", "AC", "II")]
    assert [tuple(r) for r in formats.read_pairs(spark, path).collect()] == [(1, "r1", "ACGT", "IIII", "ACGG", "@#I#")]
    sam = formats.read_sequences(spark, put("c.sam", SAM)).orderBy("idx").collect()
    assert [(r["id"], r["pos"], r["seq"], list(r["tags"])) for r in sam] == [("q1", 5, "ACGT", ["NM:i:0", "XX:Z:a"]), ("q2", 9, "GGT", [])]
    raw = formats.read_sequences(spark, put("d.raw", "ACGT\nGG\n")).orderBy("idx").collect()
    assert [r["seq"] for r in raw] == ["ACGT", "GG"]


def test_names_of_formats():
    assert [formats.format_of(x) for x in ("a.fasta", "b.FQ.gz", "c.sam", "x.raw")] == ["fasta", "fastq", "sam", "raw"]
    assert formats.corrected_path("/d/a.fastq.gz") == "/d/a.corr.fastq.gz"
    with pytest.raises(ValueError, match="unknown"):
        formats.format_of("a.txt")


def test_bad_records_are_errors(spark, tmp_path):
    (tmp_path / "x.fastq").write_text("ACGT\nACGT\n+\nIIII\n")
    (tmp_path / "y.fastq").write_text("@a\nAC\n+\nII\n@b\nAC\n+\nII\n")
    with pytest.raises(Exception, match="no FASTQ header"):
        formats.read_fastq(spark, str(tmp_path / "x.fastq")).collect()
    with pytest.raises(Exception, match="different ids"):
        formats.read_pairs(spark, str(tmp_path / "y.fastq")).collect()


def test_round_trips(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"r{k}", "ACGT" * 40, "I" * 160) for k in range(50)], "idx long, id string, seq string, qual string")
    formats.write_fastq(rows, f"{tmp_path}/q", "idx")
    back = formats.read_fastq(spark, f"{tmp_path}/q")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    formats.write_fasta(rows, f"{tmp_path}/a", "idx", "gzip")
    lines = [r["value"] for r in spark.read.text(f"{tmp_path}/a").collect()]
    assert max(map(len, lines)) == 70 and sum(x.startswith(">") for x in lines) == 50
    formats.write_network(spark.createDataFrame([(0, 1, 2, 3.14159)], "run int, src long, dst long, sim double"), f"{tmp_path}/n")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/n").collect()] == ["1\t2\t3.14"]


def test_chain_lines_round_trip(spark, tmp_path):
    schema = "id string, accepted boolean, score int, branch boolean, first_off int, last_off int, chain array<int>, status string"
    rows = spark.createDataFrame([("r1", True, 88, False, 3, 17, [4, -2, 9], "OPTIMAL"), ("r2", False, 0, False, 0, 0, [], "EXHAUSTED")], schema)
    formats.chain_lines(rows).coalesce(1).write.text(f"{tmp_path}/c")
    found = formats.read_chains(spark, f"{tmp_path}/c").drop("idx")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, rows.select(found.columns).collect()))


def test_overlap_scores_against_single_cells():
    """Strings of one length and of many, long ones and other letters."""
    rng = random.Random(4)

    def single(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                table[i][j] = max(table[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -4), table[i - 1][j] - 7, table[i][j - 1] - 7)
        ends = [table[len(a)][j] for j in range(1, len(b) + 1)] + [table[i][len(b)] for i in range(1, len(a) + 1)]
        return max([0, *ends]) if a and b else 0

    word = lambda n, letters="ACGT": "".join(rng.choices(letters, k=n))
    mixed = [(word(rng.randint(0, 12)), word(rng.randint(0, 12), "ACG\u00e9")) for _ in range(60)]
    whole = word(60)
    even = [(whole[i : i + 20], whole[j : j + 25]) for i, j in ((rng.randint(0, 40), rng.randint(0, 35)) for _ in range(40))]
    for pairs in (mixed, even, [("", "A")], [("A", "")], [("A" * 6_000 + whole, whole)]):
        left, right = [a for a, _ in pairs], [b for _, b in pairs]
        assert similarity.overlap_scores(left, right).tolist() == [single(a, b) for a, b in pairs]
