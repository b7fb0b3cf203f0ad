"""Readers over objects and sources made here, whole and broken."""

import email.parser
import email.policy
import io
import struct
import zipfile

import pytest

from granary.extract import metadata, wheel
from granary.extract.archive import UNREADABLE, Archive
from granary.extract.native import ar, elf, macho, pe, strings
from granary.plans import policy
from granary.sources import synthetic as S

POLICY = policy.load()


def evidence(content, name="pkg-1.0-py3-none-any.whl"):
    return wheel.extract(content, name, POLICY.patterns(), POLICY.targets(), POLICY.limits, POLICY.conventions)


def sites(source: str):
    return [(s["kind"], s["target"], s["line"], s["attrs"]) for s in evidence(S.build("pkg", "1.0", {"pkg/a.py": source.encode()}))["py_sites"]]


def test_elf_in_full():
    o = elf.read(S.elf(["libz.so.1", "libcrypto.so.3"], [("EVP_x", False), ("MD5_y", True), ("main", True)], b"OpenSSL 3.0.1\0wolfSSL", "libme.so"), "a.so", POLICY.patterns(), False)
    assert (o.bits, o.endian, o.machine, o.elf_type, o.soname, o.needed) == (64, "little", "EM_X86_64", "ET_DYN", "libme.so", ["libcrypto.so.3", "libz.so.1"])
    assert o.symbols == {("openssl", "EVP_x", "imported"), ("unspecified_hash_impl", "MD5_y", "defined")}
    assert o.strings == {("openssl_banner", "OpenSSL 3.0.1"), ("wolfssl", "wolfSSL")} and o.dynsym_count == 4 and o.stripped and not o.reasons


@pytest.mark.parametrize("cut", [5, 18, 60, 200])
def test_a_cut_elf_is_partial_and_never_raises(cut):
    data = S.elf(["libz.so.1"], [("EVP_x", False)], b"OpenSSL 3.0.1")
    o = elf.read(data[:cut] if cut < 100 else data[:-cut], "a.so", POLICY.patterns(), False)
    assert o.reasons and o.errors


def test_every_cut_of_every_format_is_survived():
    for data, read in ((S.elf(["a"], [("EVP_x", True)], b"x"), elf.read), (thin_macho(), macho.read), (S.pe(), pe.read)):
        for n in range(4, len(data), 7):
            read(data[:n], "x", POLICY.patterns(), False)


def thin_macho() -> bytes:
    return S.macho(["/usr/lib/libcrypto.dylib"], [("EVP_x", False), ("MD5_y", True)], "@rpath/libme.dylib")


def test_macho_thin_and_universal():
    p, data = POLICY.patterns(), thin_macho()
    o = macho.read(data, "a.dylib", p, False)
    assert (o.machine, o.soname, o.needed, o.symtab_count) == ("arm64", "@rpath/libme.dylib", ["/usr/lib/libcrypto.dylib"], 2)
    assert o.symbols == {("openssl", "EVP_x", "imported"), ("unspecified_hash_impl", "MD5_y", "defined")} and not o.reasons
    fat = struct.pack(">II", 0xCAFEBABE, 2) + struct.pack(">IIIII", 7, 0, 64, len(data), 0) + struct.pack(">IIIII", 7, 0, 64 + len(data), 20, 0)
    fat = fat + bytes(64 - len(fat)) + data + b"no slice at all....."
    o = macho.read(fat, "a.dylib", p, False)
    assert o.symtab_count == 2 and o.reasons == {"macho_fat_slice_unread"}


def test_pe_imports_exports_and_forwarders():
    o = pe.read(S.pe(), "a.dll", POLICY.patterns(), False)
    assert (o.machine, o.bits, o.soname, o.needed) == ("amd64", 64, "me.dll", ["LIBCRYPTO-3.dll", "other.dll"])
    assert o.symbols == {("openssl", "EVP_x", "imported"), ("openssl", "EVP_z", "imported"), ("unspecified_hash_impl", "MD5_y", "defined")}
    assert o.reasons == {"pe_ordinal_import"}


def test_ar_names():
    def member(name, body):
        return f"{name:<16}{0:<12}{0:<6}{0:<6}{100644:<8}{len(body):<10}`\n".encode() + body + b"\n" * (len(body) & 1)

    data = ar.MAGIC + member("//", b"a_very_long_member_name.o/\n") + member("/0", b"one") + member("short.o/", b"two!") + member("#1/8", b"bsd.o\0\0\0abc") + member("/99", b"x")
    assert [(n, b) for n, _, b in ar.members(data)] == [("a_very_long_member_name.o", b"one"), ("short.o", b"two!"), ("bsd.o", b"abc"), (None, b"x")]
    with pytest.raises(ValueError):
        list(ar.members(data[:-30]))


def test_crates_and_go():
    reg = "/home/u/.cargo/registry/src/index.crates.io-6f17d22bba15001f/ring-0.17.8/"
    crates = lambda t: strings.crates(t, POLICY.patterns().cargo_paths)
    assert crates(reg + "src/a.rs") == {("ring", "0.17.8")}
    assert crates(reg + "vendor/blst/src/b.rs") == {("ring", "0.17.8")}
    assert crates("/build/vendor/sha2/src/lib.rs") == {("sha2", None)}
    assert crates("/c/git/checkouts/boring-0123456789abcdef/abcdef0/boring/src/x.rs") == {("boring", None)}
    blob = strings.GO_MAGIC + b"\x08\x02" + bytes(16) + bytes([8]) + b"go1.22.3"
    assert strings.go_version(blob + b"more") == "go1.22.3" and strings.go_version(blob[:20]) is None
    assert strings.go_version(b"xx" + blob) is None and strings.go_version(blob.replace(b"go1", b"xo1")) is None and strings.go_version(blob[:-1]) is None


def test_python_sites():
    assert sites("import hashlib as h\nh.md5(b'')\nh.new('MD5', usedforsecurity=False)\nh.new(name)\n") == [
        ("py_call", "hashlib.md5", 2, {"algorithm": "md5", "usedforsecurity": "absent"}),
        ("py_call", "hashlib.new", 3, {"algorithm": "md5", "usedforsecurity": "false"}),
        ("py_call", "hashlib.new", 4, {"algorithm": "unresolved", "usedforsecurity": "absent"}),
        ("py_import", "hashlib", 1, {}),
    ]
    assert ("py_attr", "verify_mode", 2, {"value": "ssl.CERT_NONE"}) in sites("import ssl\nctx.verify_mode = ssl.CERT_NONE\n")
    assert not [s for s in sites("import ssl\nctx.verify_mode = ssl.CERT_NONE\n") if s[0] == "py_constant"]
    assert ("py_constant", "ssl.PROTOCOL_TLSv1", 2, {}) in sites("from ssl import PROTOCOL_TLSv1\nx = PROTOCOL_TLSv1\n")
    assert ("py_ctypes_load", "libcrypto", 2, {}) in sites("import ctypes\nctypes.CDLL('libcrypto.so.3')\n")
    assert sites("from . import hashlib\n") == []


def test_broken_sources_are_errors():
    files = {"pkg/a.py": b"def (", "pkg/b.py": b"x = 1\0", "pkg/c.py": b"# coding: nonsense\n", "pkg/d.py": b"("* 5000 + b")" * 5000}
    e = evidence(S.build("pkg", "1.0", files))
    assert {(x["stage"], x["path"]) for x in e["errors"]} == {("python", n) for n in files} and e["artifacts"]["py_files_unparsed"] == 4
    assert not e["artifacts"]["source_available"]


def test_archive_and_metadata_errors():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("pkg/a.txt", "x")
        z.writestr("pkg/a.txt", "y")
    e = evidence(out.getvalue(), "not a wheel name.whl")
    assert {x["kind"] for x in e["errors"]} == {"duplicate_member", "dist_info_missing"} and e["metadata"] is None
    e = evidence(S.build("pkg", "1.0", {}), "not a wheel name.whl")
    assert {x["kind"] for x in e["errors"]} == {"wheel_filename_invalid"} and (e["metadata"]["canonical_name"], e["metadata"]["version"], e["metadata"]["tags"]) == ("pkg", "1.0", ["py3-none-any"])
    assert [x["kind"] for x in evidence(b"no zip")["errors"]] == ["bad_zip"]
    e = evidence(S.build("pkg", "1.0", {"pkg-1.0.dist-info/sboms/a.json": b'{"components": [{"name": "ring", "purl": "pkg:cargo/ring@1", "components": [{"name": "OpenSSL"}]}]}', "pkg-1.0.dist-info/sboms/b.json": b"["}))
    assert [(c["name"], c["purl"]) for c in e["sbom"]] == [("OpenSSL", None), ("ring", "pkg:cargo/ring@1")] and [x["kind"] for x in e["errors"]] == ["sbom_parse_error"]


@pytest.mark.parametrize("data", [
    b"A: 1\nB:2\nA:  3 \n",
    b"A: 1\n\nBody: no\n",
    b"A: 1\nB: 2",
    b"A: 1\r\nB: 2\r\n",
    b"A: 1\n folded\nB: 2\n",
    b"From me\nA: 1\n",
    b"A: 1\nno header\nB: 2\n",
    b": 1\nA: 2\n",
    b"A: \xc3\xa4\nB: 2\n",
    b"A: x\x0cy\x1cz\nB: 2\n",
    b"",
    b"\n\n",
])
def test_plain_headers_are_as_the_parser_reads_them(data):
    parsed = email.parser.BytesParser(policy=email.policy.compat32).parsebytes(data, headersonly=True).items()
    strip = lambda pairs: [(k, str(v).strip()) for k, v in pairs]
    assert strip(metadata._pairs(data)) == strip(parsed)


def test_members_read_in_one_step_are_as_zipfile_reads_them():
    members = [("p/a.py", b"x = 1\n" * 99, 0o100644, True), ("p/b", b"stored", 0o600, False), ("p/c", b"", 0o600, True)]
    good = S.zipped(members)
    a = Archive(good)
    assert [a._plain(i) for i in a.zip.infolist()] == [data for _, data, _, _ in members]
    for at in range(len(good)):  # whatever is damaged
        bad = bytearray(good)
        bad[at] ^= 0x55
        try:
            a = Archive(bytes(bad))
        except UNREADABLE:
            assert [e["kind"] for e in evidence(bytes(bad))["errors"]] == ["bad_zip"]
            continue
        for name, i in a._info.items():
            try:
                wanted = a.zip.read(i)
            except Exception:
                wanted = None
            plain = a._plain(i)
            assert plain is None or plain == wanted, (at, name)
