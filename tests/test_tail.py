import pytest

from watchfloor.sources.tail import TailReader, tail


def drain(spark, folder, out, checkpoint, range_bytes=1 << 20):
    lines = tail(spark, str(folder), "audit.log*", range_bytes)
    query = lines.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return sorted(r.value for r in spark.read.schema("value string").parquet(str(out)).collect())


def test_lines_of_growing_and_rotated_files_arrive_once(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "logs", tmp_path / "out", tmp_path / "checkpoint"
    folder.mkdir()
    log = folder / "audit.log"
    written = []

    def add(path, *lines, end="\n"):
        with path.open("a", encoding="utf-8") as file:
            for line in lines:
                file.write(line + end)
        written.extend(lines)

    add(log, "one é", "two", "")
    (folder / "other.txt").write_text("not ours\n")
    (folder / "audit.log.empty").write_text("")
    with log.open("a") as file:
        file.write("half a li")
    assert drain(spark, folder, out, checkpoint) == sorted(written)
    with log.open("a") as file:  # the line is finished, the file rotated, a new one begun
        file.write("ne\n")
    written.append("half a line")
    log.rename(folder / "audit.log.1")
    add(log, "three", "four" * 50)
    assert drain(spark, folder, out, checkpoint, 64) == sorted(written)
    add(folder / "audit.log.1", "late line of the rotated file")
    add(log, *[f"line {k}" for k in range(500)])
    assert drain(spark, folder, out, checkpoint, 100) == sorted(written)
    (folder / "audit.log.1").unlink()
    assert drain(spark, folder, out, checkpoint) == sorted(written)


def test_every_split_gives_the_same_lines(tmp_path):
    text = b"a\n\n" + b"longer line\n" * 5 + "ünï\n".encode() + b"x" * 30 + b"\nend\nunfinished"
    (tmp_path / "f.log").write_bytes(text)
    want = text.decode().split("\n")[:-1]
    for size in range(1, 60):
        reader = TailReader(str(tmp_path), "*", size)
        parts = reader.partitions({}, reader.latestOffset())
        got = [line for p in parts for _, _, line in reader.read(p)]
        assert got == want, size


def test_files_that_cannot_be_told_apart_are_an_error(tmp_path):
    for name in "ab":
        (tmp_path / name).write_text("same first line\nrest\n")
    with pytest.raises(ValueError, match="begins with the same line"):
        TailReader(str(tmp_path), "*", 100).latestOffset()
