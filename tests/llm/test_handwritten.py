import pytest
from pyspark.sql import functions as F

from tessera.llm import handwritten as hw

HEADS = [("// Code generated by x. DO NOT EDIT.", True), ("# @generated by x", True), ("// <auto-generated> by x", True), ("/* eslint-disable */\n// This file was automatically created by x; changes will be lost.", True), ('"""Auto-generated widget stubs (a v8)."""', True), ("// Machine-written by x 4. Change the template instead.", True), ("// +build a\n// this file is output of go:generate b, do not modify", True), ("# Generated by the x compiler.  DO NOT EDIT!", True), ("# Produced by x on every build, edits are overwritten", True), ("# Do not edit the order of these imports, x depends on it.", False), ("// Shows the auto-generated import list of x", False), ("# Writes the generated digest report for x.", False), ("# Tests for the x code generator", False), ("// X must not be edited while y runs", False), (None, False), ("", False)]
PATHS = [("node_modules/a/b.js", True), ("web/build/static/x-1833397.js", True), ("src/builders/a_build.py", False), ("src/vendors/a.py", False), ("vendor/a/b.go", True), ("Static/JS/x.MIN.JS", True), ("static/x-min.js", True), ("src/min_max_a.py", False), ("pkg/a.pb.go", True), ("a_pb2_grpc.py", True), ("src/code_generator_a.py", False), ("static/lib/x-3.17.8.js", True), ("pkg/zz_generated_a.go", True), ("yarn.lock", True), ("src/lock_a.py", False), ("public/a.b25193b5.chunk.js", True), ("src/distribution/a.ts", False), ("", False), (None, False), ("lib/a.g.py", True), ("src/a_autogen.py", True)]


@pytest.mark.parametrize(("head", "want"), HEADS)
def test_notices(head, want):
    assert hw.has_notice(hw.notices(), head) is want


def test_paths(spark):
    df = spark.createDataFrame([(p,) for p, _ in PATHS], "p string").select("p", hw.by_path(F.col("p")).alias("b"))
    assert {(r.p, r.b) for r in df.collect()} == set(PATHS)


def test_normal_paths(spark):
    rows = [("./a/b.py", "a/b.py"), ("a\\b.py", "a/b.py"), ("/srv/repos/proj/a/b.py", "a/b.py"), ("a//./b.py", "a/b.py"), ("a/x/../b.py", "a/b.py"), ("a/b.py", "a/b.py"), ("proj/a.py", "proj/a.py"), ("C:\\w\\proj\\a.py", "a.py"), (None, None)]
    df = spark.createDataFrame(rows, "p string, want string").select("want", hw.normal_path(F.col("p"), F.lit("proj")).alias("got"))
    assert all(r.want == r.got for r in df.collect())


def test_rows(spark):
    files = spark.createDataFrame([(1, "p", "src/a.py", 10, 300, "# @generated"), (2, "p", "src/b.py", 2, 90_000, None), (3, "p", "src/c.py", 10, 300, "x"), (4, None, None, None, None, None), (5, "q", "src/a.py", 0, 0, ""), (1, "p", "src/a.py", 10, 300, "# @generated")], "file_id bigint, project_name string, file_path string, n_lines bigint, n_bytes bigint, head_text string")
    ranked = spark.createDataFrame([(1, "p", "./src/a.py", 1), (2, "p", "src\\b.py", 1), (3, "p", "src/c.py", 1), (4, "q", "src/a.py", 1), (5, "p", "vendor/x.py", 1), (6, "p", None, 1), (7, None, "src/a.py", 1)], "rank_id bigint, project_name string, file_path string, path int")
    got = {tuple(r) for r in hw.not_handwritten(files, ranked).collect()}
    assert got == {("file_symbols", "1"), ("file_symbols", "2"), ("ranked_file", "1"), ("ranked_file", "2"), ("ranked_file", "5")}
    assert {tuple(r) for r in hw.not_handwritten(files.limit(0), ranked).collect()} == {("ranked_file", "5")}
