"""Files of the writer read back by the parsers, without Spark."""

import itertools
import math
import struct

import numpy as np
import pytest

from chunkwell import errors
from chunkwell.fixtures.h5writer import NONE, UNLIMITED, Enum, Fixed, Raw, Vl, Writer, lookup3
from chunkwell.fmt.file import H5File
from chunkwell.functions import attributes as attrs
from chunkwell.functions import decode, dtype, strings
from chunkwell.plans import planner, selection
from chunkwell.sources.bytesource import ByteSource, ReadOptions, clamp, merge_ranges
from chunkwell.sources.hdf5 import ArrayPart, ArrayReader, check_readable

E, L = False, True
TYPES = ["i1", "i2", "i4", "i8", "u1", "u2", "u4", "u8", "f4", "f8"]


def ramp(shape, kind="u4"):
    return (np.arange(math.prod(shape)) % 251).astype(kind).reshape(shape)


def read(data: bytes, name="/data", ranges=None, options=None, fill="zero", stats=None):
    """The selection as a numpy array of elements, by the same planner and decoder that tasks use."""
    with H5File(data) as f:
        ds = f.dataset(name)
        check_readable(ds, "array")
        box = selection.clamp(ranges, ds.shape)
        opts = options or ReadOptions()
        reader = ArrayReader("array", {"fill": fill}, [])
        kind = np.dtype(f"V{ds.dtype.element_size}")
        out = np.empty([b - a for a, b in box], kind)
        seen = np.zeros(out.shape, int)
        source = ByteSource.open(data, opts)
        for i, g in enumerate(planner.pieces(ds, box, opts)):
            part = ArrayPart(i, "", ds.shape, ds.dtype, ds.filters, ds.fill if fill == "stored" else None, g)
            for b, v in reader._blocks(source, part, opts):
                where = tuple(slice(a - o, z - o) for (a, z), (o, _) in zip(b, box, strict=True))
                out[where], seen[where] = v, seen[where] + 1
        assert (seen == 1).all()
        if stats is not None:
            stats.append(source.stats)
        if ds.string_kind:
            raw = out.tobytes()
            return strings.fixed_strings(raw, ds.dtype.size) if ds.dtype.cls == 3 else strings.vl_strings(ds.source, raw)
        return out.view(dtype.numpy_type(ds.dtype))


def one(data, latest, attrs_=None, **options):
    w = Writer(latest)
    w.dataset("/data", data, attrs_, **options)
    return w.bytes()


def same(data, latest, **options):
    raw = one(data, latest, **options)
    assert np.array_equal(read(raw), data)
    half = [(n // 4, n - n // 4) for n in data.shape]
    assert np.array_equal(read(raw, ranges=half), data[tuple(slice(a, b) for a, b in half)])
    with H5File(raw) as f:
        return f.dataset("/data")


@pytest.mark.parametrize("latest", [E, L])
@pytest.mark.parametrize(("shape", "chunk", "kind"), [((10000,), (1000,), "u4"), ((100, 200), (32, 64), "f8"), ((10, 20, 30), (4, 8, 16), "u1"), ((1003,), (100,), "u4"), ((100,), (1,), "u4"), ((50,), (50,), "u4"), ((1,), (1,), "u4")])
def test_shapes(latest, shape, chunk, kind):
    same(ramp(shape, kind), latest, chunk=chunk)


@pytest.mark.parametrize("latest", [E, L])
@pytest.mark.parametrize("options", [{}, {"deflate": 1}, {"deflate": 1, "shuffle": True}, {"shuffle": True}])
@pytest.mark.parametrize("kind", TYPES)
def test_types_and_filters(latest, options, kind):
    ds = same(ramp((1000,), kind), latest, chunk=(300,), **options)
    assert ds.filter_names == ["Shuffle"] * ("shuffle" in options) + ["Deflate"] * ("deflate" in options)


@pytest.mark.parametrize(
    ("index", "n", "chunk", "options"),
    [
        ("SingleChunk", 64, 64, {}), ("SingleChunk", 4000, 4000, {"deflate": 1, "shuffle": True}), ("FixedArray", 10000, 100, {}), ("FixedArray", 10000, 100, {"deflate": 1, "shuffle": True}),
        ("FixedArray", 300000, 100, {}), ("ExtensibleArray", 10000, 100, {"max_dims": (UNLIMITED,)}), ("ExtensibleArray", 10000, 100, {"max_dims": (UNLIMITED,), "deflate": 1}),
        ("ExtensibleArray", 500000, 64, {"max_dims": (UNLIMITED,)}), ("ExtensibleArray", 200000, 16, {"max_dims": (UNLIMITED,), "page_bits": 6}), ("Implicit", 5000, 125, {"index": "implicit"}),
    ],
)
def test_indexes(index, n, chunk, options):
    data = ramp((n,), "u1" if n > 100000 else "u4")
    ds = same(data, L, chunk=(chunk,), **options)
    assert (ds.layout.kind, ds.index_name) == ("Chunked", index)
    assert len(ds.chunks) == -(-n // chunk)


@pytest.mark.parametrize("shape", [(200, 300), (900, 700)])
@pytest.mark.parametrize("options", [{}, {"deflate": 1}])
def test_tree2_index(shape, options):
    w = Writer(L, tree_node=512)
    data = ramp(shape)
    w.dataset("/data", data, chunk=(16, 8), max_dims=(UNLIMITED, UNLIMITED), **options)
    raw = w.bytes()
    assert np.array_equal(read(raw), data)
    with H5File(raw) as f:
        assert f.dataset("/data").index_name == "BTreeV2"


def test_tree1_of_many_levels():
    assert same(ramp((9000,), "u1"), E, chunk=(2,)).index_name == "BTreeV1"


@pytest.mark.parametrize("max_dims", [(30, UNLIMITED), (40, 60), (UNLIMITED, 90)])
def test_linear_numbers_follow_the_largest_extent(max_dims):
    same(ramp((30, 50)), L, chunk=(7, 9), max_dims=max_dims)


@pytest.mark.parametrize("latest", [E, L])
@pytest.mark.parametrize(("data", "layout"), [(ramp((10000,)), "contiguous"), (ramp((64, 96), "f8"), "contiguous"), (ramp((7, 11, 13), "i2"), "contiguous"), (ramp((500,)), "compact"), (ramp((20, 30), "f4"), "compact")])
def test_other_layouts(latest, data, layout):
    assert same(data, latest, layout=layout).layout.kind == layout.capitalize()


def test_contiguous_ranges_and_small_spans():
    data = ramp((60, 50, 4))
    raw = one(data, L)
    for ranges in ([(0, 60), (0, 50), (0, 4)], [(3, 9), (49, 99), (1, 3)], [(59, 60), (0, 1), (3, 4)], [(0, 60), (7, 8), (0, 4)], [(70, 80), (0, 1), (0, 1)]):
        want = data[tuple(slice(a, b) for a, b in ranges)]
        for partition in (1, 64, 1000, 1 << 20):
            assert np.array_equal(read(raw, ranges=ranges, options=ReadOptions(partition=partition)), want)


@pytest.mark.parametrize("latest", [E, L])
def test_scalar_and_null(latest):
    raw = one(np.float64(2.5), latest)
    assert read(raw).shape == () and read(raw)[()] == 2.5
    with pytest.raises(errors.InvalidSelectionError):
        read(raw, ranges=[(0, 1)])
    w = Writer(latest)
    w.dataset("/data", np.zeros(0), null=True)
    with H5File(w.bytes()) as f:
        ds = f.dataset("/data")
        assert ds.space.elements == 0 and planner.pieces(ds, (), ReadOptions()) == []


@pytest.mark.parametrize("latest", [E, L])
def test_missing_chunks_and_fill(latest):
    data = ramp((1000,), "i4") + 1
    raw = one(data, latest, chunk=(100,), missing={0, 3, 9}, fill=struct.pack("<i", -7), deflate=1)
    want = data.copy()
    want[0:100] = want[300:400] = want[900:] = 0
    assert np.array_equal(read(raw), want)
    assert np.array_equal(read(raw, fill="stored"), np.where(want == 0, -7, want))
    assert not read(one(data, latest, unallocated=True)).any()


@pytest.mark.parametrize("latest", [E, L])
def test_masks(latest):
    data = ramp((500,))
    for mask in (1, 2, 3):
        assert np.array_equal(read(one(data, latest, chunk=(100,), shuffle=True, deflate=1, masks={1: mask, 4: mask})), data)
    assert np.array_equal(read(one(ramp((505,)), L, chunk=(100,), deflate=1, plain_edges=True)), ramp((505,)))


def test_big_endian():
    for kind in (">i4", ">u2", ">f8"):
        assert np.array_equal(read(one(ramp((50,)).astype(kind), E)).astype("f8"), ramp((50,)).astype("f8"))


def tree_file(latest):
    w = Writer(latest)
    w.group("/", root_nums=np.array([7, 8, 9], "u4"), root_label=Fixed(["label"], 16, shape=(1,)))
    w.dataset("/nested/deeper/values", (np.arange(2000) * 0.5).reshape(40, 50), {"range": np.array([-5, 5], "i8")}, chunk=(8, 16), shuffle=True, deflate=1)
    for i in range(40):
        w.dataset(f"/many_links/item{i:03}", np.arange(8, dtype="u2") + i, chunk=(8,))
    w.dataset("/contiguous", (np.arange(1200, dtype="i4") - 600).reshape(30, 40))
    w.dataset("/compact", np.arange(24, dtype="u2"), layout="compact")
    w.dataset("/many_attrs", np.arange(16, dtype="u1"), {f"attr{i:03}": np.array([i], "u4") for i in range(40)}, chunk=(16,))
    return w.bytes()


def test_structure():
    listings = []
    for latest in (E, L):
        with H5File(tree_file(latest)) as f:
            found = f.datasets()
            assert len(found) == 44 and [d.path for d in found] == sorted(d.path for d in found)
            listings.append([(d.path, d.shape, d.dtype_info, d.filter_names) for d in found])
            got = {a.name: attrs.decode(f.source, a) for a in f.attributes("many_attrs")}
            assert {k: v.as_ints() for k, v in got.items()} == {f"attr{i:03}": [i] for i in range(40)}
            root = {a.name: attrs.decode(f.source, a) for a in f.attributes("")}
            assert root["root_nums"].as_ints() == [7, 8, 9] and root["root_label"].kind == "strs" and root["root_label"].as_str() == "label"
            assert [c.name for c in f.children(f.superblock.root)] == ["compact", "contiguous", "many_attrs", "many_links", "nested"]
            assert f.dataset("nested") is None and f.dataset("") is None and f.dataset("no/such") is None
        assert np.array_equal(read(tree_file(latest), "/nested/deeper/values"), (np.arange(2000) * 0.5).reshape(40, 50))
        assert np.array_equal(read(tree_file(latest), "many_links/item039"), np.arange(8) + 39)
    assert listings[0] == listings[1]


@pytest.mark.parametrize(("start", "most", "n"), [(512, 65536, 1500), (512, 1024, 1500), (512, 512, 300), (4096, 4096, 20)])
def test_dense_links(start, most, n):
    w = Writer(L, heap_start=start, heap_max_direct=most, tree_node=512)
    shared = w.dataset("/x", np.arange(3, dtype="u1"))
    for i in range(n):
        w.hard_link(f"/many/link{i:05}", shared)
    with H5File(w.bytes()) as f:
        assert [c.name for c in f.children(f.navigate("many"))] == [f"link{i:05}" for i in range(n)]


@pytest.mark.parametrize("latest", [E, L])
def test_attributes(latest):
    values = {
        "i1": np.array([-1, 5], "i1"), "u8": np.array([2**63 + 5, 1], "u8"), "f4": np.array([1.5], "f4"), "f8": np.float64(2.25), "f2": np.array([1, 2], "f2"), "be": np.array([258], ">i4"),
        "term": Fixed([b"ab\0cd"], 8, 0, (1,)), "nul": Fixed(["a "], 4, 1, (1,)), "spc": Fixed(["a"], 4, 2, (1,)), "scalar": Fixed(["one"], 3, 1), "vl": Vl(["löng"]), "vls": Vl(["a", "", "c" * 500], (3,)),
        "enum": Enum(np.array([1, 0], "u1")), "odd": Raw(struct.pack("<BBBBI", 0x15, 0, 0, 0, 3), b"xyz", ()),
    }
    w = Writer(latest)
    w.dataset("/data", np.zeros(2), values)
    with H5File(w.bytes()) as f:
        got = {a.name: attrs.decode(f.source, a) for a in f.attributes("data")}
    assert got["i1"].as_ints() == [-1, 5] and got["u8"].as_ints() == [5 - 2**63, 1] and got["be"].as_ints() == [258]
    assert got["f4"].as_floats() == [1.5] and got["f8"].as_floats() == [2.25] and np.isnan(got["f2"].as_floats()).all()
    assert [got[k].as_str() for k in ("term", "nul", "spc", "scalar", "vl")] == ["ab", "a ", "a", "one", "löng"]
    assert got["vl"].kind == "str" and got["vls"].as_strs() == ["a", "", "c" * 500] and got["vls"].as_str() is None
    assert got["enum"].as_ints() == [1, 0] and got["odd"].kind == "raw" and got["odd"].value == b"xyz" and got["i1"].as_str() is None


@pytest.mark.parametrize("latest", [E, L])
def test_strings(latest):
    for padding in (0, 1, 2):
        raw = one(Fixed([b"a ", b"bc", b"", b"\xff\xfe"], 4, padding), latest, chunk=(3,))
        assert read(raw) == ["a", "bc", "", "��"]
    texts = ["x" * 50_000, "", "é", "y" * 50_000, None, "z"]
    assert read(one(Vl(texts), latest, chunk=(4,))) == [t or "" for t in texts]
    assert read(one(Vl(texts), latest), ranges=[(2, 4)]) == ["é", "y" * 50_000]
    with H5File(one(Vl(texts), latest)) as f:
        with pytest.raises(errors.CorruptError):
            strings.vl_strings(f.source, struct.pack("<IQI", 3, struct.unpack_from("<Q", f.dataset("data").source.get_range(f.dataset("data").layout.address + 4, f.dataset("data").layout.address + 12))[0], 999))
    assert strings.fixed_strings(b"abc", 0) == [] == strings.padded_strings(b"", 0, 1)
    with pytest.raises(errors.UnsupportedError):
        strings.padded_strings(b"ab", 2, 7)


def test_enumeration():
    raw = one(Enum(np.array([0, 1, 1], "u1")), E)
    with H5File(raw) as f:
        ds = f.dataset("data")
        assert ds.is_enumeration and ds.dtype_info == (False, False, 1) and ds.dtype.base is not None
        with pytest.raises(errors.TypeMismatchError):
            dtype.check(ds.dtype, "u8")
    assert read(raw).tolist() == [0, 1, 1]


@pytest.mark.parametrize("latest", [E, L])
def test_links(latest):
    w = Writer(latest)
    w.dataset("/g/real", np.arange(4))
    w.soft_link("/g/soft", "/g/real")
    g = w.at("/g")
    w.hard_link("/g/loop", g)
    with H5File(w.bytes()) as f:
        assert [c.name for c in f.children(f.navigate("g"))] == ["loop", "real"]
        assert [d.path for d in f.datasets()] == ["/g/real"]
        assert f.dataset("g/loop/loop/real").shape == (4,) and f.dataset("g/soft") is None


@pytest.mark.parametrize("latest", [E, L])
def test_continuation_blocks(latest):
    data = ramp((100,))
    w = Writer(latest)
    w.dataset("/data", data, {"a": np.array([3], "i4")}, chunk=(10,), split=3)
    raw = w.bytes()
    assert np.array_equal(read(raw), data)
    with H5File(raw) as f:
        assert [a.name for a in f.attributes("data")] == ["a"]


@pytest.mark.parametrize("version", [0, 1, 2, 3])
def test_superblocks(version):
    w = Writer(version > 1, superblock=version)
    w.dataset("/data", np.arange(9))
    raw = w.bytes()
    with H5File(raw) as f:
        assert f.superblock.version == version and f.dataset("data").shape == (9,)
    with pytest.raises(errors.UnsupportedError):
        H5File(raw[:8] + b"\x09" + raw[9:])
    with pytest.raises(errors.ParseError):
        H5File(b"nothing here")
    with pytest.raises(errors.ParseError):
        H5File(b"")


def test_what_is_not_read():
    data = ramp((100,))
    with pytest.raises(errors.UnsupportedError, match="Other\\(32001\\)"):
        read(one(data, L, chunk=(10,), filters=[(32001, (1,))]), ranges=[(0, 0)])
    with pytest.raises(errors.UnsupportedError):
        read(one(data, E, deflate=1))
    virtual = one(data, L, layout="virtual")
    assert read(virtual, ranges=[(5, 5)]).size == 0
    with pytest.raises(errors.UnsupportedError):
        read(virtual)
    compound = Raw(struct.pack("<BBBBI", 0x16, 0, 0, 0, 8), bytes(16), (2,))
    w = Writer(E)
    w.dataset("/data", compound)
    w.dataset("/ok", data)
    with H5File(w.bytes()) as f, pytest.raises(errors.UnsupportedError):
        f.datasets()
    with pytest.raises(errors.UnsupportedError):
        with H5File(one(Fixed(["ab"], 2), L, chunk=(1,), shuffle=True)) as f:
            check_readable(f.dataset("data"), "array")


def test_selection_rules():
    raw = one(ramp((100,)), E, chunk=(10,))
    for ranges in ([(0, 1), (0, 1)], [(5, 2)], [(-1, 3)]):
        with pytest.raises(errors.InvalidSelectionError):
            read(raw, ranges=ranges)
    for a, b in ((0, 0), (100, 200), (95, 1000), (9, 11), (10, 20), (0, 100)):
        assert np.array_equal(read(raw, ranges=[(a, b)]), ramp((100,))[a:b])
    assert selection.parse("1:4, :7,3:,5") == [(1, 4), (0, 7), (3, None), (5, 6)] and selection.parse("") == []
    with H5File(raw) as f:
        t = f.dataset("data").dtype
        dtype.check(t, "u32")
        for wrong in ("f64", "i32", "u64", "x"):
            with pytest.raises(errors.TypeMismatchError):
                dtype.check(t, wrong)


def test_damage():
    data = ramp((5000,))
    raw = one(data, E, chunk=(1000,), deflate=1)
    with pytest.raises((errors.CorruptError, errors.ParseError)):
        read(raw[: len(raw) // 2])
    contiguous = one(data, L)
    with H5File(contiguous) as f:
        end = f.dataset("data").layout.address + 100
    with pytest.raises(errors.EngineError):
        read(contiguous[:end])
    rng = np.random.default_rng(5)
    raw = tree_file(L)
    for _ in range(150):  # any damage ends in one of the engine's own errors or in a result
        broken = bytearray(raw)
        for at in rng.integers(0, len(raw), 20):
            broken[at] = int(rng.integers(256))
        try:
            with H5File(bytes(broken)) as f:
                for d in f.datasets():
                    _ = d.chunks
        except errors.EngineError:
            pass


def test_random_files():
    rng = np.random.default_rng(1235)
    reached = set()
    for _ in range(60):
        rank = int(rng.integers(1, 4))
        shape = tuple(int(x) for x in rng.integers(1, {1: 5000, 2: 120, 3: 24}[rank], rank))
        data = ramp(shape, TYPES[int(rng.integers(10))])
        options, latest = {}, bool(rng.integers(2))
        layout = ("chunked", "contiguous", "compact")[int(rng.integers(3))]
        if layout == "compact" and data.nbytes <= 16384:
            options["layout"] = "compact"
        elif layout == "chunked":
            options["chunk"] = shape if rng.integers(8) == 0 else tuple(int(rng.integers(max(1, n // 12), n + 1)) for n in shape)
            if rng.integers(2):
                options |= {"deflate": 1, "shuffle": bool(rng.integers(2))}
            if rng.integers(2):
                options["max_dims"] = (UNLIMITED, *shape[1:])
        ds = same(data, latest, **options)
        reached |= {ds.layout.kind, ds.index_name}
    assert {"Chunked", "Contiguous", "Compact", "BTreeV1", "SingleChunk", "FixedArray", "ExtensibleArray"} <= reached


def test_ranges():
    assert merge_ranges([(10, 20), (0, 5), (25, 30), (5, 7)], 5, 100) == [(0, 30)]
    assert merge_ranges([(0, 5), (6, 9)], 0, 100) == [(0, 5), (6, 9)]
    assert merge_ranges([(0, 60), (60, 120)], 10, 100) == [(0, 60), (60, 120)]
    assert merge_ranges([], 1, 1) == []
    assert clamp(5, 10, 7) == (5, 7) and clamp(7, 9, 7) is None and clamp(1, 2, None) == (1, 2)


def test_source_counts_and_cache():
    data = bytes(range(256)) * 64
    s = ByteSource.open(data, ReadOptions(block=1024, cache=4096, gap=10, span=100))
    assert s.get_range(16000, 99999) == data[16000:] and s.get_range(99999, 100000) == b""
    assert s.read_ranges([(50, 60), (0, 10), (5, 5), (15, 20), (300, 400)]) == [data[50:60], data[0:10], b"", data[15:20], data[300:400]]
    assert (s.stats.batches, s.stats.requests) == (2, 4)
    assert s.metadata(1000, 100) == data[1000:1100] and s.metadata(1020, 10) == data[1020:1030]
    assert (s.stats.hits, s.stats.misses) == (1, 1)
    s.metadata(0, 16384)
    assert s.held <= 4096 and s.metadata(16380, 50) == data[16380:] and s.metadata(1 << 20, 5) == b""
    assert s.metadata_many([(0, 8), (5000, 8), (1 << 30, 8)]) == [data[:8], data[5000:5008], b""]
    assert b"".join(s.stream(3, 5000, 700)) == data[3:5000]


def test_prefetch_keeps_order_and_bounds(tmp_path):
    data = bytes(range(256)) * 4000
    (tmp_path / "x").write_bytes(data)
    s = ByteSource.open(str(tmp_path / "x"), ReadOptions(inflight=1000, concurrency=4))
    requests = [(i * 700, i * 700 + 650) for i in range(300)] + [(len(data) - 5, len(data) + 99), (len(data) + 1, len(data) + 9)]
    assert list(s.prefetch(requests)) == [data[a:b] for a, b in requests]
    assert s.stats.requests == len(requests)


def test_requests_are_few():
    w = Writer(E)
    for i in range(120):
        w.dataset(f"/g/d{i:03}", ramp((4096,)), chunk=(64,))
    with H5File(w.bytes()) as f:
        assert len(f.datasets()) == 120 and f.stats.batches <= 12
        before = f.stats.batches
        ds = f.dataset("g/d007")
        assert len(ds.chunks) == 64 and f.stats.batches - before <= 8
    stats = []
    read(w.bytes(), "g/d007", stats=stats)
    assert stats[0].requests <= 8
    big = one((np.arange(1 << 21) * 2654435761 % 65536).astype("u4"), E, chunk=(1 << 18,), shuffle=True, deflate=1)
    stats = []
    read(big, stats=stats)
    assert stats[0].requests <= 8 and stats[0].bytes <= len(big)


def test_grouping_never_cuts_a_chunk():
    from chunkwell.fmt.chunk_index import Chunk

    cs = [Chunk((i,), i * 100, 90) for i in range(10)] + [Chunk((10,), 5000, 9999), Chunk((11,), 15000, 10)]
    groups = planner.group_requests(cs, 10, 350)
    assert [len(g) for g in groups] == [3, 3, 3, 1, 1, 1] and list(itertools.chain(*groups)) == cs


def test_decode_functions():
    assert decode.unshuffle(b"adgbehcfi", 3) == b"abcdefghi" and decode.unshuffle(b"acbdX", 2) == b"abcd\0"
    with pytest.raises(errors.CorruptError):
        decode.unshuffle(b"ab", 0)
    import zlib

    z = zlib.compress(b"hello")
    assert decode.inflate(z + b"trailing") == b"hello"
    for bad in (z[:-3], b"junk"):
        with pytest.raises(errors.ParseError):
            decode.inflate(bad)
    with pytest.raises(errors.CorruptError):
        decode.decode_chunk(z, (), 0, 1, 99)
    assert attrs.ints_from(b"\xff\x01", 1, True) == [-1, 1] and attrs.ints_from(b"\xff" * 9, 9, True) == []


def test_checksum():
    assert lookup3(b"") == 0xDEADBEEF and lookup3(b"Four score and seven years ago") == 0x17770551 and NONE == 2**64 - 1


def test_errors_pickle():
    import pickle

    e = pickle.loads(pickle.dumps(errors.CorruptError("x")))
    assert isinstance(e, errors.CorruptError) and str(e) == "Corrupt: x"
