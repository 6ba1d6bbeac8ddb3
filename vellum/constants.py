"""Fixed values that results depend on.

Everything here must equal the behaviour being reproduced: word lists,
thresholds, scores, limits, topic names and media types.
"""

# fixed values: query stop words (English, Russian)
QUERY_STOP_WORDS = [
    "a", "about", "an", "and", "book", "books", "for", "in", "of", "on", "the", "with",
    "без", "в", "для", "и", "книга", "книге", "книги", "книгу", "о", "об", "про", "с",
]

# fixed values: words that open front matter
FRONT_MATTER_WORDS = [
    "annotation", "foreword", "introduction", "preface",
    "аннотация", "благодарности", "введение", "вступление", "предисловие",
]

# fixed values: words of a bare numbered chapter title
NUMBERED_TITLE_WORDS = ["chapter", "глава", "part", "часть"]

# fixed values: search
MIN_TERM_CHARS = 3
MIN_PREFETCH = 100
PREFETCH_PER_GROUP = 4
GROUP_SIZE = 4
PAGE_LIMIT = 20
RRF_K = 2
BM25_K1 = 1.2
BM25_B = 0.75
BM25_AVG_LEN = 256.0
SCORE_DIGITS = 8
CACHE_PREFIX = "search:rerank-snapshot:v1"
CACHE_WINDOW = 100
CACHE_TTL_SECONDS = 600
RERANK_MAX_CANDIDATES = 200
RERANK_REQUEST_CANDIDATES = 100
RERANK_TOP_K = 10
RERANK_BATCH = 16
RERANK_TIMEOUT_SECONDS = 5.0
RERANK_QUERY_CHARS = 256
RERANK_CANDIDATE_CHARS = 1600
QUERY_MAX_CHARS = 500

# fixed values: suggestions
SIMILARITY_MIN = 0.18
WORD_SIMILARITY_MIN = 0.28
TITLE_RANK = 100
AUTHOR_RANK = 80
SUGGEST_LIMIT = 8
SUGGEST_MAX_LIMIT = 10
SUGGEST_QUERY_MAX_CHARS = 120

# fixed values: chunking and packing
CHUNK_CHARS = 1200
CHUNK_OVERLAP = 200
MIN_CHUNK_CHARS = 40
CHUNK_SEPARATORS = ["\n\n", "\n", ". ", "! ", "? ", "… ", "; ", ": ", ", ", " "]
SMALL_CHAPTER_BYTES = 8 * 1024
BATCH_CHAPTERS = 24
BATCH_BYTES = 512 * 1024
UPSERT_BATCH = 128

# fixed values: uploads
ALLOWED_CONTENT_TYPES = ["application/epub+zip", "application/octet-stream"]
MAX_UPLOAD_BYTES = 200 * 1024 * 1024

# fixed values: markup
BLOCK_TAGS = (
    "article|aside|blockquote|dd|div|figcaption|figure|h[1-6]|header|li|p|section|table|td|th|tr|ul|ol"
)
NOISE_CONTAINERS = ["script", "style", "noscript", "svg", "math", "iframe", "video", "audio", "picture"]
NOISE_VOID = ["source", "track", "img"]

# fixed values: image media types
IMAGE_EXTENSIONS = {
    "image/jpeg": "jpg",
    "image/png": "png",
    "image/webp": "webp",
    "image/gif": "gif",
    "image/svg+xml": "svg",
    "image/avif": "avif",
}

# fixed values: 41-5-5-12 bit ids counted from 2026-01-01T00:00:00Z
SNOWFLAKE_EPOCH_MS = 1767225600000

# fixed values: message header names by envelope field
HEADER_NAMES = {
    "id": "id",
    "type": "x-event-type",
    "spec_version": "x-spec-version",
    "source": "x-source",
    "instance": "x-instance-id",
    "service_version": "x-app-version",
    "aggregate_id": "x-aggregate-id",
    "aggregate_type": "x-aggregate-type",
    "correlation_id": "x-correlation-id",
    "causation_id": "x-causation-id",
    "trace_parent": "traceparent",
    "trace_state": "tracestate",
    "occurred_at": "x-occurred-at",
}

# fixed values: white space of the source language's trim and \s, and a regex class of it
WS_CHARS = (
    " \t\n\x0b\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
WS = r"[ \t\n\x0B\f\r\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
