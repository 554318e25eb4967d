import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

REPO = Path(__file__).resolve().parents[1]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_text_operators():
    for p in (REPO / "crawlquarry").rglob("*.py"):
        if "llm" not in p.parts:
            assert "crawlquarry.llm" not in p.read_text(encoding="utf-8"), p


def test_entry_works_without_the_text_operators():
    code = "import sys; sys.modules['crawlquarry.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('p1_') for k in q); print('fine')"
    out = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True)
    assert out.stdout.strip() == "fine", out.stderr


def test_command_line(spark, tmp_path, capsys):
    from crawlquarry.__main__ import main

    a, b = tmp_path / "a.txt", tmp_path / "b.txt"
    a.write_text("User-agent: *\nDisallow: /\n")
    b.write_text("User-agent: *\nDisallow: /x\n")
    assert main(["audit", str(a), "--fail-on", "error"]) == 0
    assert "parser.starBlocksAll" in capsys.readouterr().out
    assert main(["audit", str(a), "--fail-on", "warning"]) == 1
    assert main(["diff", str(a), str(b), "--fail-on-change"]) == 1 and "+Disallow: /x" in capsys.readouterr().out
    assert main(["diff", str(a), str(a), "--fail-on-change"]) == 0
