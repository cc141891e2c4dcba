import io

from scriptloom.__main__ import main


def test_stdin_to_stdout(monkeypatch, capsys):
    monkeypatch.setattr("sys.stdin", io.StringIO("x=!0"))
    assert main([]) == 0
    assert capsys.readouterr().out == "x = true;\n"


def test_folder_is_refused_unless_forced(tmp_path, capsys):
    (tmp_path / "a.js").write_text("!function(e){function n(r){return e[r].call()}n(n.s=0)}([function(e,t,n){e.exports=1}])")
    out = tmp_path / "out"
    args = [str(tmp_path / "a.js"), "-o", str(out)]
    assert main(args) == 0
    assert sorted(p.name for p in out.iterdir()) == ["bundle.json", "deobfuscated.js", "index.js"]
    assert main(args) == 1
    assert "exists" in capsys.readouterr().err
    assert main([*args, "-f"]) == 0
