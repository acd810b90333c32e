import pytest
from pyspark.sql import functions as F

from tessella.operators import chunk, parse
from tessella.sources import files


def kinds(blocks):
    return [(b["type"], b["content"]) for b in blocks]


def test_markdown():
    text = "# Title\n\nintro line\nmore\n- a\n- b\n> quote\n```php\n  $x = 1;\n```\n1. one\n## Sub"
    assert kinds(parse.parse_markdown(text)) == [("heading", "Title"), ("paragraph", "intro line\nmore"), ("list", "- a\n- b"), ("quote", "> quote"), ("code", "  $x = 1;"), ("paragraph", "1. one"), ("heading", "Sub")]
    assert parse.parse_markdown("```js\nx")[0]["meta"] == {} and parse.parse_markdown(text)[4]["meta"] == {"language": "php"}


def test_html():
    got = parse.parse_html("<h2>A &amp; B</h2><p>x<br>y</p><ul><li>1</li></ul><pre>c</pre><div>lost</div><p> </p>")
    assert kinds(got) == [("heading", "A & B"), ("paragraph", "x\ny"), ("list", "1"), ("code", "c")] and got[0]["level"] == 2
    assert kinds(parse.parse_html("<div>only</div>")) == [("paragraph", "only")]


def test_json_and_xml():
    assert kinds(parse.parse_json('{"a": [1, {"b": null}], "c": "x"}')) == [("section", "a"), ("section", "0"), ("paragraph", "1"), ("section", "1"), ("section", "b"), ("paragraph", "null"), ("section", "c"), ("paragraph", "x")]
    assert kinds(parse.parse_xml("<r><a>t</a><b><c>u</c></b></r>")) == [("section", "r"), ("section", "a"), ("paragraph", "t"), ("section", "b"), ("section", "c"), ("paragraph", "u")]
    for bad in ("{", "<a>", "<!DOCTYPE x><a/>"):
        with pytest.raises(parse.ParseError):
            (parse.parse_json if bad == "{" else parse.parse_xml)(bad)


def test_source_code():
    got = parse.parse_php("<?php\n$a = 'class X';\nfunction f() { return 1; }\n// function no\nclass B {}\n")
    assert [b["content"].splitlines()[0] for b in got] == ["<?php", "function f() { return 1; }", "class B {}"]


PAGES = "[[PAGE:1]]\nCapítulo 1 Filas\nUma fila guarda itens em ordem.\n\nA    B     C\n\n[[PAGE:2]]\n- um\n- dois\n\nclass Fila {}\n\nx  y\nz  w e mais palavras aqui"


def blocks_of(spark, text, meta):
    df = spark.createDataFrame([(text, meta)], "content string, metadata map<string,string>")
    return [r.asDict(recursive=True) for r in parse.parsed(df).select(F.explode("blocks")).select("col.*").collect()]


def test_pages(spark):
    got = blocks_of(spark, PAGES, {"format": "pdf"})
    assert [(b["type"], b["excluded"]) for b in got] == [("heading", False), ("paragraph", False), ("diagram_text", True), ("list", False), ("code", False), ("table", False)]
    assert got[0]["level"] == 1 and [b["meta"]["page_start"] for b in got] == ["1", "1", "1", "2", "2", "2"]
    assert [b["type"] for b in blocks_of(spark, "no marks\n\nhere", {"format": "pdf"})] == ["paragraph", "paragraph"]


def test_format_is_told_by_metadata(spark):
    assert blocks_of(spark, "# x", {"source": "a.md"})[0]["type"] == "heading"
    assert blocks_of(spark, "# x", {"source": "a.md", "type": "text"})[0]["type"] == "paragraph"
    assert blocks_of(spark, "# x", {"type": "text", "format": "markdown"})[0]["type"] == "heading"


@pytest.mark.parametrize("text,size,overlap", [("longword" * 9, 23, 5), ("👩🏽‍💻é 😀 " * 12, 31, 7), ("a\nb\n\nc. d e\n" * 6, 20, 4), ("one two. three four! five " * 5, 17, 0), ("x" * 50, 16, 3), ("ab cd ef gh " * 9, 10, 9)])
def test_windows_cover_the_text(text, size, overlap):
    parts = chunk.windows(text, size, overlap)
    joined = parts[0] + "".join(p[overlap:] for p in parts[1:])
    assert all(len(p) <= size for p in parts) and joined.strip() == text.strip()


def test_recursive_chunks(spark):
    df = spark.createDataFrame([("d", "t", "first part. " * 10)], "document_id string, tenant_id string, content string")
    rows = chunk.recursive_chunks(df, size=50, overlap=10).orderBy("position").collect()
    assert [r["position"] for r in rows] == list(range(len(rows))) and len({r["chunk_id"] for r in rows}) == len(rows)
    with pytest.raises(ValueError):
        chunk.recursive_chunks(df, size=10, overlap=10)


def test_structural_chunks(spark):
    text = "# Um\n\ntexto curto\n\nmais texto\n\n## Dois\n\n" + "palavra " * 20 + "\n\n# Tres\n\nfim"
    df = spark.createDataFrame([("d", "t", text, {"format": "md", "k": "v"})], "document_id string, tenant_id string, content string, metadata map<string,string>")
    rows = chunk.structural_chunks(df, chunk.Limit("characters", 45)).orderBy("position").collect()
    assert all(len(r["content"]) <= 45 for r in rows)
    assert rows[0]["content"] == "Um\n\ntexto curto\n\nmais texto" and rows[0]["hierarchy"] == ["Um"] and rows[1]["hierarchy"] == ["Um", "Dois"] and rows[-1]["hierarchy"] == ["Tres"]
    assert rows[0]["metadata"]["k"] == "v" and rows[0]["metadata"]["block_type"] == "heading"


def test_limits():
    blocks = [parse._block("paragraph", c) for c in ("aa", "bb", "cc")]
    assert [c["content"] for c in chunk.packed(blocks, chunk.Limit("blocks", 2))] == ["aa\n\nbb", "cc"]
    assert chunk.Limit("tokens", 2).fits("x" * 8, 1) and not chunk.Limit("tokens", 2).fits("x" * 9, 1)
    assert chunk.Limit("characters", 10).pieces("abcdefgh ijklmnop") == ["abcdefgh", "ijklmnop"]
    with pytest.raises(ValueError):
        chunk.Limit("pages", 1)


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n\nfirst\nline\n\n \nsecond\n\n\n", "utf-8")
    rows = files.read_text_files(spark, str(tmp_path), "t", granularity="paragraph", metadata={"type": "note"}).collect()
    assert sorted(r["content"] for r in rows) == ["first\nline", "second"] and rows[0]["metadata"]["type"] == "note"
    assert files.read_text_files(spark, str(tmp_path), "t").first()["content"].startswith("first")
    with pytest.raises(ValueError):
        files.read_text_files(spark, str(tmp_path), "t", granularity="word")


def test_page_windows(spark):
    texts = spark.createDataFrame([("f.pdf", "one\f \ftwo [[PAGE:9]] x\fthree\ffour\f")], "path string, value string")
    pages = files.pages(texts)
    assert pages.count() == 5
    rows = files.page_windows(pages, "t", pages_a_window=3).orderBy("content").collect()
    assert [r["metadata"]["page_start"] + "-" + r["metadata"]["page_end"] for r in rows] == ["1-4", "5-5"]
    assert "[[SOURCE_PAGE:9]]" in rows[0]["content"] and rows[0]["content"].startswith("[[PAGE:1]]\none")


def test_pdf_files_go_through_the_program(spark, tmp_path):
    import os

    from tessella.errors import PdfExtractionError
    from tessella.sources.files import extract_pages, page_text, pages

    program = tmp_path / "program"
    program.write_text("#!/bin/sh\ncase \"$*\" in *'-l 2'*) printf 'one\\ftwo\\f';; *) cat >/dev/null; printf 'one\\ftwo\\fthree\\f';; esac\n")
    os.chmod(program, 0o755)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"%PDF-1.7 x")
    for most, want in ((None, ["one", "two", "three"]), (2, ["one", "two"])):
        rows = pages(extract_pages(spark, str(tmp_path / "in"), max_pages=most, program=str(program))).orderBy("page").collect()
        assert [r["text"] for r in rows] == want and [r["page"] for r in rows] == list(range(1, len(want) + 1))
    how = {"max_bytes": 100, "max_pages": None, "timeout": 5}
    for raw, call, match in ((b"text", str(program), "no PDF"), (b"%PDF-" + b"x" * 200, str(program), "no PDF"), (b"%PDF-1", "/no/such/program", "not installed"), (b"%PDF-1", "/bin/false", "exit code")):
        with pytest.raises(PdfExtractionError, match=match):
            page_text("a.pdf", raw, program=call, **how)
    with pytest.raises(ValueError):
        extract_pages(spark, str(tmp_path), max_pages=0)


def test_windowed_counts_of_a_stream(spark, tmp_path):
    from tessella.streaming.ingest import windowed_counts

    schema = "ts timestamp, event_type string, value double"
    rows = [("2026-01-01 10:05:00", "a", 1.0), ("2026-01-01 10:55:00", "a", 2.0), ("2026-01-01 11:01:00", "b", 3.0), ("2026-01-01 14:00:00", "a", 5.0)]
    late = [("2026-01-01 10:10:00", "a", 100.0), ("2026-01-01 15:30:00", "b", 1.0)]
    for part in (rows, late):  # the second file comes when the first was counted
        spark.createDataFrame(part, "ts string, event_type string, value double").selectExpr("cast(ts as timestamp) as ts", "event_type", "value").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        query = windowed_counts(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    got = {(r["starts"].hour, r["event_type"]): (r["n"], r["value"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # the late row came after the watermark had passed its window; the last window is still open
    assert got == {(10, "a"): (2, 3.0), (11, "b"): (1, 3.0), (14, "a"): (1, 5.0)}


def test_declarations_in_heredocs_are_text():
    from tessella.operators.parse import parse_php

    source = "<?php\n$a = <<<TXT\nclass Inside {}\n  TXT;\n$b = <<<'RAW'\nfunction no() {}\nRAW;\nclass A {}\n"
    assert [b["content"] for b in parse_php(source)] == [source[: source.index("class A")].strip(), "class A {}"]
