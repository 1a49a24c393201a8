"""Language labels as they are written in records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of languages as they occur in labels, by ISO 639-1 code.
LANGUAGE_NAMES = {
    "en": "eng english inglés inggris 영어 英語",
    "ko": "kor korean coreano korea 한국어 韓国語",
    "id": "ind indonesian indonesio indonesia 인도네시아어 インドネシア語",
    "es": "spa spanish español castellano spanyol 스페인어 スペイン語",
    "ja": "jpn japanese japonés jepang 일본어 日本語",
    "zh": "zho chi chinese chino mandarin 중국어 中国語",
    "fr": "fra fre french français francés 프랑스어 フランス語",
    "de": "deu ger german deutsch alemán 독일어 ドイツ語",
    "pt": "por portuguese português 포르투갈어",
    "it": "ita italian italiano 이탈리아어",
    "ru": "rus russian русский 러시아어",
    "ar": "ara arabic العربية 아랍어",
    "hi": "hin hindi 힌디어",
    "th": "tha thai 태국어",
    "vi": "vie vietnamese 베트남어",
    "ms": "msa may malay melayu 말레이어",
    "tr": "tur turkish türkçe 터키어",
    "nl": "nld dut dutch nederlands 네덜란드어",
    "pl": "pol polish polski 폴란드어",
    "sv": "swe swedish svenska 스웨덴어",
    "uk": "ukr ukrainian 우크라이나어",
    "tl": "tgl fil tagalog filipino 타갈로그어",
}


def label_code(label: Column) -> Column:
    """The ISO 639-1 code that a label names (any case, region or script subtag, three-letter
    code or name); null for null, blank and labels that name no known language."""
    plain = F.regexp_replace(F.lower(F.trim(label)), r"^[\s\p{P}]+|[\s\p{P}]+$", "")
    names = {name: code for code, words in LANGUAGE_NAMES.items() for name in (code, *words.split())}
    known = F.create_map(*[F.lit(x) for item in sorted(names.items()) for x in item])
    return F.coalesce(F.try_element_at(known, plain), F.try_element_at(known, F.regexp_extract(plain, r"^([^\s_\-(/,;]+)", 1)))
