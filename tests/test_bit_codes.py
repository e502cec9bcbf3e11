import numpy as np
import pytest

from prunella.sources.bit_codes import coded_longs, coded_records, encoded, global_frequencies


def plain(data: bytes, code: str, n: int) -> list[int]:
    """A code after another."""
    bits, at, out = "".join(f"{b:08b}" for b in data), 0, []

    def gamma():
        nonlocal at
        z = bits.index("1", at) - at
        at += 2 * z + 1
        return int(bits[at - z - 1 : at], 2) - 1

    for _ in range(n):
        if code == "gamma":
            out.append(gamma())
        else:
            digits = gamma()
            out.append(int("1" + bits[at : at + digits], 2) - 1)
            at += digits
    return out


def numbers(rng, n):
    return np.concatenate([rng.integers(0, 4, n), rng.integers(0, 1 << 20, n), rng.integers(0, (1 << 62) - 1, n // 4), [0, (1 << 62) - 2, (1 << 53) - 1, 1 << 53]])


def test_known_codes():
    assert encoded([0, 1, 2, 3]) == bytes([0b10100110, 0b01000000])
    assert encoded([0, 1, 2, 9], "delta") == bytes([0b10100010, 0b10010001, 0])
    with pytest.raises(ValueError, match="from 0"):
        encoded([-1])


@pytest.mark.parametrize("code", ["gamma", "delta"])
def test_files_read_by_ranges(spark, tmp_path, code):
    rng = np.random.default_rng(4)
    files = {}
    for name, n in (("a", 3000), ("b", 1), ("c", 0)):
        values = rng.permutation(numbers(rng, n)) if n else np.zeros(0, np.int64)
        data = encoded(values, code)
        assert plain(data, code, len(values)) == values.tolist()
        (tmp_path / name).write_bytes(data)
        files[name] = values.tolist()
    for size in (64, 1000, 1 << 16):
        found = {name: [] for name in files}
        for r in coded_longs(spark, str(tmp_path), code, size).orderBy("path", "ord").collect():
            assert r["ord"] == len(found[r["path"][-1]])
            found[r["path"][-1]].append(r["value"])
        assert found == files


def test_a_code_that_fills_the_last_short_range(spark, tmp_path):
    """The last code begins in the first range and ends where the file ends, within a range of a few bits."""
    values = np.asarray([0] * 449 + [(1 << 35) - 1])  # 449 + 71 bits
    data = encoded(values)
    assert len(data) == 65
    (tmp_path / "f").write_bytes(data)
    assert [r["value"] for r in coded_longs(spark, str(tmp_path / "f"), size=64).orderBy("ord").collect()] == values.tolist()


def test_frequencies_and_records(spark, tmp_path):
    (tmp_path / "f").write_bytes(encoded([5, 0, 7]))
    assert {r["term_id"]: r["df"] for r in global_frequencies(spark, str(tmp_path / "f")).collect()} == {0: 5, 1: 0, 2: 7}
    (tmp_path / "r").write_bytes(encoded([1, 20, 3, 4, 50, 6], "delta"))
    assert sorted(map(tuple, coded_records(spark, str(tmp_path / "r"), ["doc_id", "size", "n_terms"], "delta").collect())) == [(0, 1, 20, 3), (1, 4, 50, 6)]
