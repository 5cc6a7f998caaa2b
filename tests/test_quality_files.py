"""Quality entries as text read in ranges of bytes, and as packed blocks: whole entries back, blocks and files left out, and what is an error."""

import io
import json
import random

import pytest

from readloom.functions.quality_codec import block_codes, pack_entry, run_symbol, unpack_entry
from readloom.sources import quality_files
from readloom.sources.quality_files import NAME, SCHEMA, TEXT, Reader, Writer, packed_block, register, text_entries, unpacked_block


def made(rng, well, plain=False, n=None):
    n = rng.choice((0, 1, 5, 300, 700)) if n is None else n
    values = [rng.choice("!!!!!!!!!!#$@") for _ in range(n)]
    tags = [rng.choice("acgtnACGTN") if plain else "n" if v == "!" else rng.choice("acgt") for v in values]
    line = lambda: "".join(chr(min(126, 33 + int(rng.expovariate(0.2)))) for _ in range(n))
    return well, f"@movie/{well}/0_{n} RQ=0.85", "".join(values), "".join(tags), line(), line(), line()


def text_of(rows, end="\n"):
    return "".join(x + end for r in rows for x in r[1:]).encode()


@pytest.mark.parametrize("plain", [False, True])
def test_a_blocks_entries_come_back(plain):
    rng = random.Random(4)
    lines = [made(rng, i, plain)[2:] for i in range(30)]
    codes, char = block_codes(lines)
    assert (char is None) == plain
    for five in lines:
        p = pack_entry([five[0].encode(), *(x.encode() for x in five[2:])], five[1], codes, char)
        assert unpack_entry(p, codes, char) == list(five)
    assert run_symbol([("!#", "na"), ("#", "n")]) is None and run_symbol([("!!", "nn")]) == ord("!") and run_symbol([]) is None
    assert run_symbol([("!#!", "nan"), ("!", "c")]) is None and run_symbol([("!#", "nA")]) is None


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_any_ranges_give_each_entry_once(end):
    rng = random.Random(5)
    rows = [made(rng, i, n=rng.choice((0, 1, 7))) for i in range(12)]
    data = text_of(rows, end)
    for split in (1, 2, 3, 7, 10, 33, 64, 1000, len(data)):
        found = [r for at in range(0, len(data), split) for r in text_entries(io.BytesIO(data), at, min(at + split, len(data)))]
        assert found == rows
    assert list(text_entries(io.BytesIO(data.rstrip() if rows[-1][2] else data), 0, len(data))) == rows
    assert list(text_entries(io.BytesIO(b""), 0, 0)) == []


@pytest.mark.parametrize("split", [40, 1 << 20])
def test_broken_text_is_an_error(split):
    rng = random.Random(6)
    good = text_of([made(rng, 1, n=8)])
    lines = good.split(b"\n")
    short = b"\n".join([*lines[:3], lines[3][:-1], *lines[4:]])
    for data, said in ((good + b"stray\n" + good, "no head"), (b"stray\n" + good, "no head"), (short + good, "unequal"), (good + good[: len(good) - 9], "cut short")):
        with pytest.raises(ValueError, match=said):
            for at in range(0, len(data), split):
                list(text_entries(io.BytesIO(data), at, min(at + split, len(data))))


def test_text_and_blocks_through_spark(spark, tmp_path, monkeypatch):
    register(spark)
    rng = random.Random(7)
    rows = [made(rng, i, plain=i % 5 == 0) for i in range(80)]
    for k in range(2):
        (tmp_path / "text").mkdir(exist_ok=True)
        (tmp_path / "text" / f"part{k}.txt").write_bytes(text_of(rows[40 * k : 40 * k + 40]))
    (tmp_path / "text" / "_SUCCESS").write_bytes(b"not an entry")
    load = lambda split: spark.read.format(TEXT).option("split", split).load(str(tmp_path / "text"))
    assert sorted(map(tuple, load(500).collect())) == rows == sorted(map(tuple, load(1 << 20).collect()))
    assert [tuple(r) for r in spark.read.format(TEXT).load(str(tmp_path / "text" / "part1.txt")).orderBy("well").collect()] == rows[40:]
    path = str(tmp_path / "packed")
    load(5000).repartitionByRange(3, "well").sortWithinPartitions("well").write.format(NAME).mode("append").save(path)
    back = lambda: spark.read.format(NAME).load(path)
    assert sorted(map(tuple, back().collect())) == rows
    assert sorted(map(tuple, back().where("well >= 30 and well < 45").collect())) == rows[30:45]
    assert back().where("well = 500").collect() == [] and len(json.load(open(f"{path}/_qualities.json"))) == 3
    more = spark.createDataFrame([made(rng, 900)], SCHEMA)
    more.write.format(NAME).mode("append").save(path)
    assert back().count() == 81
    more.write.format(NAME).mode("overwrite").save(path)
    assert [r["well"] for r in back().collect()] == [900]
    more.limit(0).write.format(NAME).mode("overwrite").save(path)
    assert back().count() == 0


def test_blocks_outside_the_bounds_are_not_read(tmp_path, monkeypatch):
    monkeypatch.setattr(quality_files, "BLOCK_BYTES", 2000)
    rng = random.Random(8)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    rows = [made(rng, i, n=100) for i in range(20)]
    writer = Writer(str(tmp_path), False)
    message = writer.write(iter([dict(zip(names, r, strict=True)) for r in rows]))
    writer.commit([message, None])
    assert (message.n, message.low, message.high) == (20, 0, 19)
    reader = Reader(str(tmp_path))
    (part,) = reader.partitions()
    tuples = lambda: [tuple(r.values()) for b in reader.read(part) for r in b.to_pylist()]
    assert tuples() == rows
    file = tmp_path / message.name
    data = bytearray(file.read_bytes())
    size = quality_files._BLOCK.unpack_from(data)[0]
    data[quality_files._BLOCK.size : quality_files._BLOCK.size + size] = bytes(size)  # the first block, of wells 0 to 3
    file.write_bytes(data)
    reader.low, reader.high = 4, 9
    assert tuples() == rows[4:12]  # whole blocks; Spark filters the rows
    reader.low = 3
    with pytest.raises(ValueError):
        tuples()
    file.write_bytes(data[:-1])
    with pytest.raises(ValueError, match="bytes"):
        tuples()


def test_failures(spark, tmp_path):
    register(spark)
    with pytest.raises(Exception, match="columns"):
        spark.range(3).write.format(NAME).mode("append").save(str(tmp_path / "a"))
    with pytest.raises(Exception, match="no committed"):
        spark.read.format(NAME).load(str(tmp_path / "a")).count()
    with pytest.raises(Exception):
        spark.read.format(TEXT).load(str(tmp_path / "none")).count()
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    with pytest.raises(ValueError, match="unequal"):
        packed_block([dict(zip(names, (1, "@m/1/0_2 RQ=0.1", "!!", "nn", "a", "bb", "cc"), strict=True))])
    block = packed_block([dict(zip(names, (1, "@m/1/0_0 RQ=0.1", "", "", "", "", ""), strict=True))])
    assert list(unpacked_block(block[quality_files._BLOCK.size :])) == [(1, "@m/1/0_0 RQ=0.1", "", "", "", "", "")]
