"""Word lists and tables that results depend on."""

# Matching results are defined by exactly these lists.
STOPWORDS = ("the", "a", "an", "and", "of", "to", "my", "you", "your", "in", "for", "with")
JUNK_TOKENS = (
    "1080p", "2160p", "720p", "480p", "4k", "8k", "uhd", "hd", "sd", "xxx",
    "hevc", "x264", "x265", "h264", "h265", "mp4", "wmv", "mkv", "avi", "mov",
    "full", "clip", "video", "part", "pt", "feat", "ft",
)
SCAN_EXTS = (".mp4", ".mkv", ".wmv", ".avi", ".mov", ".m4v", ".flv", ".ts", ".webm")
CONTAINER_EXTS = SCAN_EXTS + (
    ".mpeg", ".mpg", ".mpe", ".m1v", ".m2v", ".mpv", ".mp2",
    ".m2ts", ".mts", ".vob", ".ogv", ".ogm", ".asf",
    ".divx", ".xvid", ".rm", ".rmvb",
    ".3gp", ".3g2", ".f4v", ".qt", ".dv", ".mxf", ".wtv", ".amv",
)
ENCODE_MARKERS = (
    "h264", "h265", "h266", "x264", "x265", "x266", "hevc", "avc",
    "8bit", "10bit", "12bit",
    "240p", "360p", "480p", "576p", "720p", "1080p", "1440p", "2160p",
    "4k", "8k", "uhd",
    "sdr", "hdr",
    "webdl", "bluray", "remux",
    "aac", "ac3", "eac3", "dts", "truehd",
)
CONTAINER_NAMES = (
    "video", "videos", "clip", "clips", "vid", "vids", "movie", "movies", "media",
    "download", "downloads", "upload", "uploads", "content", "files", "misc",
)
ARTICLE_LEADS = ("a", "an", "the", "my", "your", "no", "how", "when", "why")
#: Letters without a decomposition, and what they fold to.
LETTER_FOLD = {"ł": "l", "Ł": "L", "ø": "o", "Ø": "O", "æ": "ae", "Æ": "AE", "đ": "d", "Đ": "D", "ß": "ss", "\u1e9e": "SS"}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
MONTH_PATTERN = (
    r"jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|"
    r"sep(?:t)?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
)
#: Markup that counts as a fault in a description, and the named references that do.
TAG_NAMES = (
    "a", "abbr", "article", "aside", "b", "blockquote", "br", "code", "dd",
    "div", "dl", "dt", "em", "font", "footer", "h1", "h2", "h3", "h4", "h5",
    "h6", "header", "hr", "i", "img", "li", "nav", "ol", "p", "pre", "q", "s",
    "section", "small", "span", "strike", "strong", "sub", "sup", "table",
    "tbody", "td", "tfoot", "th", "thead", "tr", "u", "ul",
)
NAMED_REFERENCES = {
    "amp": "&", "apos": "'", "bull": "•", "copy": "©", "deg": "°", "gt": ">", "hellip": "…",
    "ldquo": "“", "lsquo": "‘", "lt": "<", "mdash": "—", "middot": "·", "ndash": "–", "nbsp": "\u00a0",
    "quot": '"', "rdquo": "”", "reg": "®", "rsquo": "’", "trade": "™",
}
#: Inbox headings and the subject types that each shows.
INBOXES = {
    "scenes": ("scene",),
    "tags": ("tag", "tag-cluster", "tag-performer", "tag-unused"),
    "performers": ("performer", "performer-enrichment"),
}
ENRICHMENT_FIELDS = (
    "details", "disambiguation", "piercings", "tattoos", "eye_color", "country", "gender", "measurements",
    "career_length", "birthdate", "ethnicity", "alias_list", "urls", "height_cm",
)
LIST_FIELDS = ("alias_list", "urls")
FINGERPRINT_ALGORITHMS = ("MD5", "OSHASH", "PHASH")
EXACT_ALGORITHMS = ("MD5", "OSHASH")
# End of fixed values.
