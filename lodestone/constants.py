"""Fixed values that results depend on."""

DENSE_TOP_K, LEXICAL_TOP_K, FINAL_TOP_K = 50, 20, 8
RRF_K = 60
SEMANTIC_WEIGHT, VECTOR_WEIGHT, POSITION_WEIGHT = 0.5, 0.3, 0.2
#: The share of code among the candidates from which their fused order is kept.
CODE_RATIO = 0.6
STRICT_THRESHOLD, RELAXED_THRESHOLD, WEAK_THRESHOLD, WEAK_TOP_K = 0.65, 0.50, 0.15, 5
PER_PAGE_CAP = 3
HEADING_WEIGHT = 5
BM25_K1, BM25_B = 1.2, 0.75
COVERAGE_MAX, COVERAGE_AVG = 0.82, 0.75
CASCADE_THRESHOLD, CASCADE_TOP_K = 0.80, 3
CHUNK_CHARS, CHUNK_OVERLAP_CHARS = 4096, 600
MAX_QUERY_TERMS = 24
PAGE_REPEAT_PENALTY = 0.07
VERSION_PENALTY, VERSION_PENALTY_MAX = 0.15, 0.30
MAX_INDEX_TOKENS = 400
CATALOG_URL_THRESHOLD = 0.7
EXPANSION_PAGES, EXPANSION_CHUNKS, EXPANSION_PULL, EXPANSION_KEEP = 2, 10, 200, 48
#: Words that carry no query meaning.
FILLER_WORDS = (
    "a", "about", "all", "also", "an", "and", "any", "are", "as", "at", "be", "been", "but", "by", "can", "could", "did", "do", "does", "for", "from",
    "get", "give", "has", "have", "how", "i", "if", "in", "into", "is", "it", "its", "just", "know", "like", "me", "my", "need", "no", "not", "of", "on",
    "one", "only", "or", "our", "out", "over", "please", "should", "show", "so", "some", "tell", "than", "that", "the", "their", "them", "then", "there",
    "these", "they", "this", "to", "up", "us", "use", "want", "was", "we", "what", "when", "where", "which", "who", "why", "will", "with", "would", "you", "your",
)
#: Words that don't select chunks of a page.
EXPANSION_FILLER = (
    "the", "and", "for", "are", "but", "not", "you", "all", "can", "had", "her", "was", "one", "our", "out", "has", "have", "been", "with", "this", "that",
    "from", "they", "what", "when", "your", "which", "their", "there", "would", "about", "into", "than", "them", "then", "these", "some", "such", "only",
    "other", "also", "how", "any", "may", "type", "types", "pin", "pins", "page", "docs", "documentation", "schema", "schemas",
)
#: Domains under which sites are registered at the third label.
TWO_PART_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "co.za")
#: Path segments that name no topic.
GENERIC_SEGMENTS = ("docs", "doc", "documentation", "en", "api", "www", "v1", "v2", "blob", "tree", "raw", "refs", "heads", "main", "master")
