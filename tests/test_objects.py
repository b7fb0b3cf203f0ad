"""Awkward objects: every query against its SQL, and readers against hostile bytes."""

import struct

import numpy as np
import pytest

from granary.extract.native import elf, macho, strings
from granary.extract.native.common import NAME_BYTES, Names
from granary.extract.wheel import _capped
from granary.plans import object_queries, part_queries, policy
from granary.sources import synthetic as S
from granary.sources import synthetic_objects as O

from .test_tables import DATA, con, rows  # noqa: F401

POLICY = policy.load()


@pytest.mark.parametrize("name", sorted(object_queries.SQL))
def test_object_query(spark, con, name):  # noqa: F811
    assert rows(object_queries.QUERIES[name](spark, DATA).toPandas()) == rows(con.sql(object_queries.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(part_queries.SQL))
def test_part_query(spark, con, name):  # noqa: F811
    assert rows(part_queries.QUERIES[name](spark, DATA).toPandas()) == rows(con.sql(part_queries.SQL[name]).df())


def test_no_query_hides_another():
    import __spark_entry__ as entry

    every = [k for m in entry.MODULES for k in m.QUERIES]
    assert len(every) == len(set(every)) and set(entry.oracle_sql()) <= set(entry.queries())


def test_names_are_read_in_full_or_not_at_all():
    table = b"\0" + b"a" * NAME_BYTES + b"\0" + b"b" * (NAME_BYTES + 1) + b"\0ok\x01\xffay\0open"
    n = Names(table)
    assert n.at(0) == "" and n.at(1) == "a" * NAME_BYTES and n.at(NAME_BYTES + 2) is None
    assert n.at(len(table) - 11) == "okay" and n.at(len(table) - 4) is None and n.at(len(table)) is None and n.at(-1) is None
    n.left = 3
    assert n.at(1) == "a" * NAME_BYTES and n.at(2) is None  # what was read stays known


def test_hidden_names():
    p = POLICY.patterns()
    assert p.hides_a_name(b"\0helper\0EVP_x\0", set()) and not p.hides_a_name(b"\0helper\0EVP_x\0", {"EVP_x"})
    assert p.hides_a_name(b"\0E\x01VP_x", set()) and not p.hides_a_name(b"\0xEVP_x\0", set())
    assert p.hides_a_name(b"\0_EVP_x\0", set(), "_") and not p.hides_a_name(b"\0_EVP_x\0", {"EVP_x"}, "_")


def test_names_all_at_once_are_the_names_one_by_one():
    """Random tables, places in the middle of names and past the end, names without an end."""
    p, r = POLICY.patterns(), np.random.default_rng(4)
    words = [b"EVP_x", b"_EVP_y", b"my_EVP_z", b"MD5_a", b"", b"q", b"_", b"SSL_new", b"helper", b"c" * (NAME_BYTES + 5)]
    for i in range(200):
        table = b"\0" + b"\0".join(words[k] for k in r.integers(0, len(words), 12)) + (b"\0" if i % 2 else b"")
        at = r.integers(0, len(table) + 3, 40)
        for abi in ("", "_"):
            n = Names(table)
            every = [n.at(int(x)) for x in at]
            claimed = {k for k, x in enumerate(every) if x and p.groups_of(x.removeprefix(abi))}
            rows_, whole = p.likely(table, at, abi)
            assert claimed <= set(rows_.tolist()) and whole == (None not in every)
    assert p.likely(b"\0a\x01b\0", np.array([1])) is None and p.likely(b"\0" + (b"x" * 8000 + b"\0") * 1100, np.arange(1100) * 8001 + 1) is None


def test_a_quarter_million_symbols_take_little_time():
    """Most names begin like none of a group, which is seen of all at once."""
    import time

    p = POLICY.patterns()
    many = [f"function_number_{i:06x}" for i in range(250_000)] + ["EVP_DigestInit_ex"]
    table, at = O.names(*many)
    data = O.elf([(".dynstr", 3, 2, 0x100, table, "", 0), (".dynsym", 11, 2, 0, O.symbols(*[(at[n], True) for n in many]), ".dynstr", 24)])
    began = time.process_time()
    o = elf.read(data, "x.so", p, False)
    assert time.process_time() - began < 2 and o.symbols == {("openssl", "EVP_DigestInit_ex", "defined")} and o.dynsym_count == len(many) + 1 and not o.reasons
    image = S.macho([], [(n, True) for n in many])
    began = time.process_time()
    o = macho.read(image, "x", p, False)
    assert time.process_time() - began < 2 and o.symbols == {("openssl", "EVP_DigestInit_ex", "defined")} and not o.reasons and not o.stripped


def test_sections_meant_to_be_overlooked():
    p = POLICY.patterns()
    strtab, at = O.names("EVP_DigestInit_ex")
    rows_ = O.symbols((at["EVP_DigestInit_ex"], True))
    for sections, reason in (
        ([(".dynsym", 7, 2, 0, rows_, ".dynstr", 24), (".dynstr", 3, 2, 0, strtab, "", 0)], "elf_dynsym_unread"),
        ([(".dynsym", 11, 2, 0, rows_, ".dynstr", 24), (".two", 11, 2, 0, rows_, ".dynstr", 24), (".dynstr", 3, 2, 0, strtab, "", 0)], "elf_section_type_ambiguous"),
        ([(".symtab", 2, 0, 0, rows_[:-1], ".strtab", 24), (".strtab", 3, 0, 0, strtab, "", 0)], "elf_symtab_unread"),
    ):
        o = elf.read(O.elf(sections), "x.so", p, False)
        assert reason in o.reasons and ("elf_parse_error" in [k for k, _ in o.errors])
    o = elf.read(O.elf([(".symtab", 2, 0, 0, rows_, ".strtab", 24), (".strtab", 3, 0, 0, strtab, "", 0)]), "x.so", p, False)
    assert o.symbols == {("openssl", "EVP_DigestInit_ex", "defined")} and not o.reasons


def test_macho_tables_are_held_against_their_names():
    p = POLICY.patterns()
    whole = S.macho([], [("helper", True), ("EVP_x", True)])
    assert not macho.read(whole, "x", p, False).reasons
    at = whole.index(struct.pack("<II", 2, 24)) + 12
    short = whole[:at] + struct.pack("<I", 1) + whole[at + 4 :]
    assert macho.read(short, "x", p, False).reasons == {"macho_symtab_incomplete", "symtab_understates_rows"}


def test_vendor_folders():
    paths = POLICY.patterns().cargo_paths
    reg = "/root/.cargo/registry/src/i/bar-1.0.0/"
    found = lambda t: {n for n, _ in strings.crates(t, paths)}
    assert found(reg + "vendor/ring/src/x.rs") == found(reg + "a/b/vendor/ring/src/x.rs") == {"bar"}
    assert found(reg + "src/lib.rs/x/vendor/ring/src/x.rs") == found(reg + "a b vendor/ring/src/x.rs") == found(reg + "/".join("abcdefghijklmnopq") + "/vendor/ring/src/x.rs") == {"bar", "ring"}


def test_caps_keep_one_of_each_and_pinned_ones_first():
    items = [(k, i) for k in "abcd" for i in range(3)]
    assert _capped(items, lambda x: x[0], 12) == (items, False)
    assert _capped(items, lambda x: x[0], 5) == ([("a", 0), ("a", 1), ("b", 0), ("c", 0), ("d", 0)], True)
    assert _capped(items, lambda x: x[0], 2, lambda x: x[0] == "d") == ([("a", 0), ("d", 0)], True)
    assert _capped(items, lambda x: x[0], 5, lambda x: x[0] == "d") == ([("a", 0), ("b", 0), ("c", 0), ("d", 0), ("d", 1)], True)
    many = [(f"c{i:05d}", None) for i in range(20_000)]
    assert len(_capped(many, lambda x: x[0], 128)[0]) == 128


def test_readers_of_ones_own(spark):
    """A format that the engine does not know."""
    from granary.extract.native.common import Obj, read_strings
    from granary.plans import scan

    def read(data, path, p, vendored):
        o = Obj(path, "unknown", vendored, machine="mine", needed=["libcrypto.so.3"])
        read_strings(o, p, data)
        return o

    own = policy.load()
    own.read_by(b"MINE", read)
    wheel = S.build("own", "1.0", {"own/_ext.so": b"MINE" + bytes(80) + b"OpenSSL 3.0.14"})
    row = scan.evidence(spark.createDataFrame([("own-1.0-py3-none-any.whl", bytearray(wheel))], "filename string, content binary"), own).first()
    assert [(b["machine"], b["needed"], b["partial_analysis"]) for b in row["binaries"]] == [("mine", ["libcrypto.so.3"], False)]
