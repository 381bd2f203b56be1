"""Patterns, characters and thresholds that results depend on."""

#: White space as Unicode text processing knows it.
WS = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NOT_WS = WS.replace("[", "[^", 1)

# Garbled text.
GARBLE_MIN_CHARS = 30
GARBLE_INVALID_SHARE = 0.05
GARBLE_LATIN_SHARE = 0.25
GARBLE_TOP_SHARE = 0.40
GARBLE_TOP_MIN_CHARS = 50
GARBLE_DOCUMENT_SHARE = 0.05
INVALID_CHARS = r"[\x{FFFD}\x{00}-\x{1F}\x{80}-\x{9F}\x{E000}-\x{F8FF}]"
#: U+0080 to U+00FF without the signs · × ÷ ± ° § µ ¥ £ © ®
LATIN_CHARS = (
    r"[\x{80}-\x{A2}\x{A4}\x{A6}\x{A8}\x{AA}-\x{AD}\x{AF}\x{B2}-\x{B4}\x{B6}\x{B8}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]"
)
CID = r"\(cid:\s*\d+\s*\)"
MOJIBAKE = "锟斤拷"
TOP_CHARS_KEPT = "，。、；：？！…—－·（）《》“”‘’【】"
TEXT_LAYER_MIN_CHARS = 100
TEXT_LAYER_PAGE_SHARE = 0.5

# Line checks.
GLUED_TOKEN = r"[A-Za-z0-9/+·\-]{8,}"
GLUE = r"[a-z][A-Z]|[A-Z][A-Z][a-z]|[A-Za-z]\d|\d[A-Za-z]"
TAIL_WORD = r"[A-Za-z]{2,}$"
HEAD_WORD = r"^[A-Za-z]{2,}"
SKIPPED_LINE = r"^\s*(\||#|```|!\[|\[.*\]\(|[-*+]\s|>\s|\d+\.\s)"
RESIDUE = r"PAGEREF|mso-|\[if |field-(?:begin|separator|end)"
GLUED_NUMBER = r"^\d+(?:\.\d+)+[^\s.\d]"
GLUED_CAPTION = r"^(?:图|表)\d+[^ 0-9\s]"
CAPTION = r"^((?:图|表)\s*\d+\s*\S.*)$"
IMAGE_LINE = r"^!\[([^\]]*)\]\(([^)]+)\)\s*$"

# Tables of contents.
TOC_CLASS = r"MsoToc([1-9])"
TOC_NUMBER = r"^(第[0-9一二三四五六七八九十百]+章|\d+(?:\.\d+)*)\s+(.+)$"
TOC_MIN_RUN = 3

# Headings of page layouts.
HEADING_SECTIONS = (
    r"^第[一二三四五六七八九十百0-9]+[章节篇][^0-9.,，。]{0,20}$",
    r"^(?:附录|附件)[0-9]{0,2}[^0-9.,，。]{0,20}$",
    r"^附表\d+[:：].{0,25}$",
    r"^(?:引言|前言|概述|总则|简介)$",
)
HEADING_SUBSECTIONS = (
    r"^目录$",
    r"^第[一二三四五六七八九十百]+部分[^0-9]{0,15}$",
    r"^\d{1,2}．\S.{0,20}$",
    r"^\d{1,2}、\S.{0,20}$",
)
BODY_STARTS = ("包括", "及", "和", "与", "指", "的", "或", "为", "按", "详见")
BODY_SIGNS = r"[,，。；?!？!]|详见|了"
HEADING_MAX_CHARS = 45
BOLD_HEADING_MAX_CHARS = 30
PAGE_OF_PAGES = r"第\s*(\d+)\s*/\s*(\d+)\s*页"
BARE_PAGE_NUMBER = r"^[-—–.\s]*\d{1,4}[-—–.\s]*$"
PRINT_DATE = "打印日期"
LINE_GAP = 20.0

# Markdown.
SEPARATOR_ROW = r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$"
ATX = r"^(#{1,6})(?:\s+(.*?))?\s*$"
FENCE = r"^\s*(`{3,}|~{3,})\s*([\w+#.\-]*)\s*$"
RULE = r"^\s*((?:-\s*){3,}|(?:\*\s*){3,}|(?:_\s*){3,})$"
BULLET = r"^\s*[-*+]\s+(.+)$"
ORDERED = r"^\s*(\d{1,9})[.)]\s+(.+)$"
QUOTE = r"^(\s*>+)"
IMAGE_BLOCK = r"^!\[([^\]]*)\]\(\s*([^)\s]+)\s*\)\s*$"
DATE_BLOCK = r"""^\s*<div\s+class=["']date["']>(.+?)</div>\s*$"""
ATTACHMENT_BLOCK = r"""^\s*<div\s+class=["']attachment["']>(.+?)</div>\s*$"""
INLINE = (
    r"\*\*[^*]+\*\*|~~[^~\n]+~~|`[^`\n]+`|\*[^*\n]+\*"
    r"|!\[[^\]\n]*\]\([^)\s]+\)|\[[^\]\n]+\]\([^)\s]+\)|<br\s*/?>|&nbsp;"
)
EMPTY_TITLE = "（空标题）"
NOTHING = "（无）"

# Counters.
CN_DIGITS = "一二三四五六七八九"
CN_UNITS = "十百千"
CN_ZERO = "零"
LEGAL_DIGITS = "壹贰叁肆伍陆柒捌玖"
LEGAL_UNITS = "拾佰仟"
IDEOGRAPHS = "〇一二三四五六七八九"
CIRCLED = ((1, 20, 0x2460), (21, 35, 0x3251), (36, 50, 0x32B1))
ONES = (
    "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen",
    "fifteen", "sixteen", "seventeen", "eighteen", "nineteen",
)
TENS = ("ten", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")
#: Ordinals that aren't made by their ending alone.
ORDINALS = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}
AIUEO = "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわゐゑをん"
IROHA = "いろはにほへとちりぬるをわかよたれそつねならむうゐのおくやまけふこえてあさきゆめみしゑひもせす"

# Recognised boxes.
ROW_TOLERANCE = 0.5
COLUMN_GAP = 8
TABLE_ROW_SHARE = 0.6

# Images.
INCH_DOTS = 96
MAX_WIDTH_IN, MAX_HEIGHT_IN = 6.0, 8.5
FULL_PAGE_COVER = 0.9
COVERAGE_ALARM = 98.5
