"""Character classes of the text rules, as text that Java, RE2 and Python regular expressions read alike."""

# They must equal these for right results.
WS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CJK = "\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
CLAUSE_OR_END = "。！？；：…—”」’』）】》〗〔〕〉⟩］｝＞.?!"
DIALOG_OPENERS = "“‘「『﹁﹃"
DIALOG_PAIRED = "”’」』﹂﹄"
DIALOG_CLOSERS = "”’」』﹂﹄〞〟"
BRACKET_OPENERS = "（(［[｛{＜<⟨〈【《〔〖"
BRACKET_CLOSERS = "）)］]｝}＞>⟩〉】》〕〗"
STRONG_END = "。！？!?"
COMMAS = "，,、"
COLONS = "：:"
POSTFIX_CLOSERS = "）)"
CHAPTER_MARKERS = "章节部卷節回"
CHAPTER_TRAIL = "】》〗〕〉」』）］＞⟩"
NOT_AFTER_MARKER = "分合"
NOT_IN_HEADING = "，,。！？；"
NUMERALS = "一二三四五六七八九十"
METADATA_SEPARATORS = "：:・\u3000"
HEADING_WORDS = ("前言", "序章", "终章", "尾声", "后记", "番外", "尾聲", "後記")
DIVIDERS = "\u2500-\u257f=_~～*＊★☆-"
METADATA_KEYS = (
    "書名", "书名", "作者", "譯者", "译者", "校訂", "校订", "出版社", "出版時間", "出版时间", "出版日期",
    "版權", "版权", "版權頁", "版权页", "版權信息", "版权信息", "責任編輯", "责任编辑", "編輯", "编辑", "責編",
    "责编", "定價", "定价", "前言", "序章", "終章", "终章", "尾聲", "尾声", "後記", "后记",
    "品牌方", "出品方", "授權方", "授权方", "電子版權", "数字版权", "掃描", "扫描", "OCR", "CIP", "在版編目",
    "在版编目", "分類號", "分类号", "主題詞", "主题词", "發行日", "发行日", "初版", "ISBN",
)
LATINISH = r"""A-Za-z0-9.,!?:;'"()\[\]{}\-_/\\@#$%&*+=<>"""
LATIN_LETTERS = "\u00c0-\u024f\u1e00-\u1eff"


def inside(chars: str) -> str:
    """chars as the inside of a character class, every one for itself."""
    return "".join("\\" + c if c in r"\]^-[&~" else c for c in chars)
