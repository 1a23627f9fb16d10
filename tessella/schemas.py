"""The model's tables as explicit schemas (DDL, as readers take it). Ids are BINARY in a repository; operators compare ids only, so tests may use integers."""

OBJECTS = ("kind string, id binary, key string, size bigint, modified timestamp, replica boolean")
SNAPSHOTS = ("key string, client binary, time_ns bigint, host string, user string, parent string, roots array<struct<path:binary,tree:binary>>, stats struct<files:bigint,dirs:bigint,symlinks:bigint,bytes:bigint>")
TREE_ENTRIES = (
    "tree binary, seg_no int, seq bigint, n binary, t tinyint, mk tinyint, size bigint, target binary, ct tinyint, chunks array<binary>, subtree binary, "
    "mode bigint, uid bigint, gid bigint, mtime_ns bigint, ctime_ns bigint, dev bigint, ino bigint, nlink bigint, xattrs map<binary,binary>, etag binary, vern binary"
)
PACK_ENTRIES = ("pack binary, seq int, chunk binary, offset bigint, length bigint, raw_len bigint")
INDEX_BLOBS = ("blob binary, packs array<struct<pack:binary,size:bigint,entries:array<struct<chunk:binary,offset:bigint,length:bigint,raw_len:bigint>>>>, supersedes array<binary>")
MARKS = ("id binary, modified timestamp")
PARITY = ("pack binary, k tinyint, m tinyint, pack_size bigint, shard_len bigint, hashes array<binary>, parity array<binary>")
JOBS = ("job string, status string, repo string, started timestamp, duration_secs double, detail string, error string")

#: Entry types and metadata kinds.
FILE, DIR, SYMLINK = 0, 1, 2
POSIX, SFTP, S3, GENERIC = 0, 1, 2, 3
