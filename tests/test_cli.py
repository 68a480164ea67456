"""The command line on the CLI fixture: output and exit codes."""

import pytest
from fixtures import CLI, container, make_records, section

from beaconry.__main__ import main
from beaconry.functions import wire


@pytest.fixture()
def path(tmp_path):
    p = tmp_path / "c.dtl"
    p.write_bytes(container(CLI, b"cli-smoke-key"))
    return str(p)


def test_verbs(spark, path, tmp_path, capsys):
    def out(*args, code=0):
        assert main(list(args)) == code
        return capsys.readouterr().out

    assert out("decode", path).startswith("0 HEARTBEAT uptime_s=1200 seq=5\n")
    assert out("query", "seq > 3", path) == "0 HEARTBEAT uptime_s=1200 seq=5\n"
    assert out("dump", path).startswith("version=1 flags=0x01 sections=3 hmac=yes\n")
    assert out("verify", path, "--key", b"cli-smoke-key".hex()) == "verify: OK\n" and "FAIL" in out("verify", path, "--key", "00", code=1) and "no-key" in out("verify", path, code=1)
    assert "records: 9" in out("stats", path) and "HEARTBEAT  2" in out("index", path)
    assert out("validate", path).endswith("-> OK\n")
    assert "ordering-violations=1" in out("timeline", path) and "1 candidates" in out("topk", path, "battery.pct", "--n", "3")
    assert "dropped 0" in out("dedup", path, str(tmp_path / "d")) and "took 3" in out("sample", path, str(tmp_path / "s"), "--n", "3", "--seed", "42")
    assert "kept 1" in out("select", "type == LOG", path, str(tmp_path / "k"))
    (tmp_path / "x.csv").write_text(out("export", path, "csv"))
    out("import", str(tmp_path / "x.csv"), str(tmp_path / "i"))
    assert (tmp_path / "i").is_file() and out("diff", path, str(tmp_path / "i")) == "" and "record 0" in out("diff", path, str(tmp_path / "s"), code=1)
    out("repack", path, str(tmp_path / "r"), "lz77"), out("merge", str(tmp_path / "m"), path, path), out("split", path, str(tmp_path / "p")), out("sign", path, str(tmp_path / "g"), "--key", "0102")
    assert len(list((tmp_path / "p").glob("split_*.dtl"))) == 7 and "verify: OK" in out("verify", str(tmp_path / "g"), "--key", "0102")
    for bad in (("decode", str(tmp_path / "none")), ("query", "seq >", path), ("topk", path, "nope"), ("repack", path, str(tmp_path / "z"), "zip"), ("export", path, "xml")):
        out(*bad, code=1)
    with pytest.raises(SystemExit) as e:
        main(["topk", path, "battery.pct", "--n", "x"])
    assert e.value.code == 2


def test_faults_and_keys(spark, tmp_path, capsys):
    good = section(make_records(3)[:2])
    (tmp_path / "cut.dtl").write_bytes(wire.build_container([(1, 0, good + b"\x7f\x00\x00")]))
    assert main(["decode", str(tmp_path / "cut.dtl")]) == 1
    printed = capsys.readouterr()
    assert [x.split()[:2] for x in printed.out.splitlines()] == [["0", "HEARTBEAT"], ["1", "GEO"]] and "malformed record" in printed.err
    (tmp_path / "empty.dtl").write_bytes(wire.build_container([]))
    assert main(["dump", str(tmp_path / "empty.dtl")]) == 0 and capsys.readouterr().out == "version=1 flags=0x00 sections=0 hmac=no\n"
    merged = str(tmp_path / "merged.dtl")
    assert main(["generate", "7", str(tmp_path / "g.dtl")]) == 0 and main(["merge", merged, str(tmp_path / "g.dtl"), str(tmp_path / "g.dtl")]) == 0
    capsys.readouterr()
    assert main(["index", merged]) == 0 and {x.split()[1] for x in capsys.readouterr().out.splitlines()} == {"2"}
    assert main(["make-key", "a seed"]) == 0
    key = capsys.readouterr().out.strip()
    assert key == wire.derive_key(b"a seed").hex()
    assert main(["sign", merged, str(tmp_path / "s.dtl"), "--seed", "a seed"]) == 0 and main(["verify", str(tmp_path / "s.dtl"), "--key", key]) == 0 and main(["verify", str(tmp_path / "s.dtl"), "--seed", "other"]) == 1
    assert main(["make-key", ""]) == 1 and main(["select", "type == 99", merged, str(tmp_path / "none.dtl")]) == 0 and main(["stats", str(tmp_path / "none.dtl")]) == 0
