"""Vocabularies: what the normaliser, the decomposition and the barriers know, injected as values.

DEFAULT is a compact vocabulary of medical procedure names.  Phrases are listed with their accents; the
unaccented spellings follow by rule.  A site's own tables go in the same shape.  Fixed values in DEFAULT are the
number and precedence of categories and modalities and the pairs of modalities that exclude each other; the
phrases are a selection of common terms of the trade.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field


def bare(text: str) -> str:
    """The text without marks."""
    return "".join(c for c in unicodedata.normalize("NFD", text.replace("đ", "d")) if not unicodedata.combining(c))


def spellings(phrases: list[str]) -> list[str]:
    """Each phrase and its unaccented spelling, without repeats, in order."""
    return list(dict.fromkeys(s for p in phrases for s in (p, bare(p))))


@dataclass(frozen=True)
class Vocabulary:
    abbreviations: dict[str, str] = field(default_factory=dict)
    compounds: list[tuple[str, str]] = field(default_factory=list)
    synonyms: list[tuple[str, str]] = field(default_factory=list)
    #: Abbreviation -> (words before it, phrases after it) between which it stays as it is.
    kept_words: dict[str, tuple[list[str], list[str]]] = field(default_factory=dict)
    doubled: list[str] = field(default_factory=list)
    #: Category -> (display name, terms), in order of precedence.
    ontology: dict[str, tuple[str, list[str]]] = field(default_factory=dict)
    #: Modality -> patterns, in order of precedence; the display names apart.
    modalities: dict[str, list[str]] = field(default_factory=dict)
    modality_names: dict[str, str] = field(default_factory=dict)
    #: Modality -> (pattern, phrases whose presence rules that pattern out).
    excluded: dict[str, list[tuple[str, list[str]]]] = field(default_factory=dict)
    #: A modality that certain phrases force wherever they stand.
    forced: tuple[str, list[str]] | None = None
    #: Category -> the modality that it implies where no pattern does.
    implied: dict[str, str] = field(default_factory=dict)
    conflicts: list[tuple[str, str]] = field(default_factory=list)
    actions: list[str] = field(default_factory=list)
    modifiers: list[str] = field(default_factory=list)
    fillers: list[str] = field(default_factory=list)
    specialties: list[str] = field(default_factory=list)

    def expansion(self, abbreviation: str) -> str | None:
        return self.abbreviations.get(abbreviation.strip().lower())

    def terms(self, category: str) -> list[str]:
        """A category's spellings, longest first."""
        return sorted(spellings(self.ontology[category][1]), key=lambda t: -len(t))


DEFAULT = Vocabulary(
    abbreviations={
        "pt": "phẫu thuật", "tt": "thủ thuật", "ns": "nội soi", "ptns": "phẫu thuật nội soi", "sa": "siêu âm", "xq": "x quang", "ct": "cắt lớp vi tính", "clvt": "cắt lớp vi tính",
        "mri": "cộng hưởng từ", "ecg": "điện tâm đồ", "tlt": "tiền liệt tuyến", "ctc": "cổ tử cung", "tc": "tử cung", "tm": "tĩnh mạch", "đm": "động mạch", "dd": "dạ dày", "cs": "cột sống",
        "xn": "xét nghiệm", "đl": "định lượng", "nkq": "nội khí quản", "phcn": "phục hồi chức năng", "tmh": "tai mũi họng", "rhm": "răng hàm mặt",
    },
    compounds=[
        ("đm/tm", "động mạch và tĩnh mạch"), ("pt/tt", "phẫu thuật thủ thuật"), ("ct/mri", "cắt lớp vi tính và cộng hưởng từ"), ("cs vết thương", "chăm sóc vết thương"), ("cs bệnh nhân", "chăm sóc bệnh nhân"),
        ("pt ns", "phẫu thuật nội soi"), ("chụp ct", "chụp cắt lớp vi tính"), ("chụp xq", "chụp x quang"), ("đặt nkq", "đặt ống nội khí quản"), ("ns dạ dày", "nội soi dạ dày tá tràng"),
    ],
    synonyms=[("mổ đẻ", "phẫu thuật lấy thai"), ("mổ lấy thai", "phẫu thuật lấy thai"), ("điện tim", "điện tâm đồ"), ("thông đái", "thông tiểu"), ("chọc nước màng phổi", "chọc dò khoang màng phổi")],
    kept_words={"sa": (["phẫu", "thuật", "pt", "điều", "trị", "khâu", "treo"], ["tử cung", "sinh dục", "trực tràng", "bàng quang"])},
    doubled=["chăm sóc", "phẫu thuật", "thủ thuật", "nội soi", "siêu âm", "cắt lớp vi tính"],
    ontology={
        "NURSING": ("Điều dưỡng", ["ống thông", "vết thương", "dẫn lưu", "sonde"]),
        "LAB": ("Xét nghiệm", ["đường huyết", "glucose", "khí máu", "huyết học"]),
        "OBSTETRICS": ("Sản - Phụ khoa", ["tử cung", "cổ tử cung", "buồng trứng", "âm hộ", "âm đạo", "tầng sinh môn", "thai"]),
        "EYE": ("Mắt", ["mắt", "bờ mi", "mi", "giác mạc", "thể thủy tinh", "võng mạc"]),
        "ENT": ("Tai - Mũi - Họng", ["tai", "mũi", "họng", "thanh quản", "amidan"]),
        "DENTAL": ("Răng - Hàm - Mặt", ["răng", "hàm", "lợi"]),
        "DIGESTIVE": ("Tiêu hóa", ["dạ dày", "đại tràng", "trực tràng", "ruột thừa", "ruột", "gan", "túi mật", "thực quản"]),
        "URINARY": ("Tiết niệu - Nam học", ["bàng quang", "thận", "niệu quản", "niệu đạo", "tiền liệt tuyến"]),
        "CHEST": ("Hô hấp - Lồng ngực", ["phổi", "màng phổi", "khí quản", "phế quản", "nội khí quản"]),
        "HEART": ("Tim mạch", ["tim", "động mạch", "tĩnh mạch", "van tim"]),
        "BONE": ("Cơ xương khớp", ["xương", "khớp", "khớp gối", "khớp háng", "cột sống"]),
        "NERVE": ("Thần kinh", ["sọ", "não", "thần kinh"]),
        "SKIN": ("Da - Mô mềm", ["da", "mô mềm", "áp xe"]),
    },
    modalities={
        "INTERVENTION": ["đặt ống thông", "đặt sonde", "đặt ống", "rút ống", "thông tiểu", "dẫn lưu", "chọc dò", "chọc hút", "rửa", "thụt", "bơm", "tiêm", "truyền", "thay băng", "hút đờm", "đặt"],
        "LAB": ["xét nghiệm", "định lượng", "định tính", "đo đường huyết", "đo nồng độ", "nuôi cấy", "đo"],
        "SURGERY": ["phẫu thuật", "mổ", "cắt", "khâu", "tạo hình", "ghép", "nạo", "tán sỏi", "kết hợp xương", "mở thông"],
        "IMAGING": ["chụp", "siêu âm", "cộng hưởng từ", "xạ hình"],
        "FUNCTION": ["điện tâm đồ", "điện não đồ", "điện cơ", "đo hô hấp ký"],
        "PHYSIO": ["vật lý trị liệu", "phục hồi chức năng", "tập vận động", "châm cứu", "sóng ngắn"],
        "CONSULT": ["khám", "hội chẩn", "tư vấn"],
    },
    modality_names={"INTERVENTION": "Thủ thuật can thiệp", "LAB": "Xét nghiệm", "SURGERY": "Phẫu thuật", "IMAGING": "Chẩn đoán hình ảnh", "FUNCTION": "Thăm dò chức năng", "PHYSIO": "Vật lý trị liệu", "CONSULT": "Khám"},
    excluded={"SURGERY": [("cắt", ["cắt lớp", "cắt chỉ"])], "INTERVENTION": [("tiêm", ["thuốc cản quang", "thuốc đối quang"])]},
    forced=("IMAGING", ["chụp x quang", "chụp cắt lớp", "chụp cộng hưởng từ"]),
    implied={"NURSING": "INTERVENTION", "LAB": "LAB"},
    conflicts=[("INTERVENTION", "LAB"), ("SURGERY", "LAB"), ("SURGERY", "PHYSIO"), ("IMAGING", "INTERVENTION"), ("LAB", "IMAGING")],
    actions=["khâu phục hồi", "khâu", "phẫu thuật", "cắt bỏ", "cắt", "tạo hình", "ghép", "nạo", "hút", "dẫn lưu", "chọc dò", "chọc hút", "đặt", "rút", "rửa", "bơm", "chụp x quang", "chụp", "siêu âm", "đo", "xét nghiệm", "định lượng", "nội soi", "thay băng"],
    modifiers=["liên tục", "ngắt quãng", "tại giường", "cấp cứu", "thường quy", "tự động", "bằng máy", "một lần", "nhiều lần", "kỹ thuật", "quy trình"],
    fillers=["bằng", "và", "có", "dưới", "của", "tại"],
    specialties=["tai mũi họng", "răng hàm mặt", "mắt", "ngoại khoa", "nội khoa", "hồi sức cấp cứu", "gây mê hồi sức", "chẩn đoán hình ảnh", "xét nghiệm", "sản phụ khoa", "nhi khoa", "da liễu", "thần kinh"],
)
