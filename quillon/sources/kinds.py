"""Tables of names, extensions and signatures, and what they say about a file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of folders that a scan leaves out. Fixed values.
EXCLUDED = (
    ".git", ".hg", ".svn", "node_modules", "target", "bin", "obj", "build", "dist", ".cache",
    ".vscode", ".idea", "__pycache__", ".venv", "venv", ".gradle", ".next", ".nuxt",
    "$RECYCLE.BIN", "System Volume Information", ".Trash", ".Trashes", ".Spotlight-V100",
    ".fseventsd", "lost+found",
)
#: Names that an operating system keeps for itself. Fixed values.
SYSTEM = ("desktop.ini", "thumbs.db", "ntuser.dat", "pagefile.sys", "hiberfil.sys", "swapfile.sys", ".ds_store")
#: Extensions by kind. Fixed values.
KINDS = {
    "pdf": "pdf ai",
    "word": "doc dot docx docm dotx dotm odt ott fodt rtf wpd pages",
    "spreadsheet": "xls xlt xla xlsx xlsm xltx xltm xlam xlsb ods ots csv tsv tab psv numbers",
    "presentation": "ppt pps pot pptx pptm potx potm ppsx ppsm odp otp key",
    "web": "html htm xhtml shtml mht mhtml hta",
    "data": "json jsonl ndjson geojson har xml xsd xsl xslt yaml yml toml ini cfg conf config properties plist rss atom kml gpx svg sql env reg",
    "ebook": "epub fb2 mobi azw azw3",
    "image": "png jpg jpeg gif bmp tif tiff webp heic heif ico psd raw cr2 nef dng",
    "text": "txt text md markdown mdown rst adoc asciidoc org tex bib log nfo srt vtt eml msg mbox pst ost vcf ics",
    "code": "diff patch editorconfig gitignore gitattributes rs c h cpp hpp cc hh cxx hxx cs java kt kts go py pyw rb php pl pm lua r scala swift m mm js jsx ts tsx mjs cjs vue svelte css scss sass less sh bash zsh fish ps1 psm1 psd1 bat cmd gradle cmake mk dockerfile tf hcl proto graphql gql dart ex exs erl hrl hs clj cljs fs fsx vb vbs asm s groovy jl nim zig sol ipynb rake gemspec cabal elm ml mli pas f90 f for ada adb ads lisp el scm rkt v sv vhd vhdl tcl awk sed",
}
#: Extensions that are never text. Fixed values.
BINARY = (
    "exe dll so dylib o obj a lib bin iso img dmg 7z rar gz tgz bz2 xz zst lz4 jar war ear class "
    "pyc pyo png jpg jpeg gif bmp tif tiff webp ico heic heif psd raw cr2 nef dng mp3 mp4 m4a m4v "
    "wav flac ogg opus aac avi mkv mov wmv webm flv ttf otf woff woff2 eot sqlite sqlite3 db mdb accdb "
    "pst ost msi msix cab apk ipa deb rpm vmdk vhd vhdx qcow2 vdi pdb idb ilk blend fbx 3ds dwg dxf "
    "sys drv efi wasm node pak dat idx lock swp tmp xlsb one mobi azw azw3 numbers pages key"
).split()
#: First bytes of formats that are not text. Fixed values.
MAGIC = (
    b"\x7fELF", b"MZ", b"\x89PNG", b"\xff\xd8\xff", b"GIF8", b"BM", b"II*\0", b"MM\0*", b"\x1f\x8b", b"7z\xbc\xaf", b"Rar!", b"\xfd7zXZ", b"BZh",
    b"\x00\x00\x01\x00", b"OggS", b"fLaC", b"ID3", b"RIFF", b"\x1aE\xdf\xa3", b"\xca\xfe\xba\xbe", b"\xcf\xfa\xed\xfe", b"\xce\xfa\xed\xfe",
    b"SQLite format 3", b"wOFF", b"wOF2", b"\0asm",
)
_KIND_OF = {e: k for k, es in KINDS.items() for e in es.split()}


def kind_of(ext: str) -> str:
    return _KIND_OF.get(ext, "other")


def kind(ext: Column) -> Column:
    """The kind of an extension, ``other`` for those that no kind has."""
    pairs = F.create_map(*[F.lit(x) for e, k in _KIND_OF.items() for x in (e, k)])
    return F.coalesce(F.element_at(pairs, F.lower(ext)), F.lit("other"))


def is_binary(ext: Column) -> Column:
    return F.lower(ext).isin(*BINARY)
