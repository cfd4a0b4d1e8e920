"""Thai, which is written without spaces between words: the terms of a text, and other forms of a term."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that only shape a question.
SHAPING = """
วันนี้ ตอนนี้ ขณะนี้ เมื่อวาน สัปดาห์นี้ อาทิตย์นี้ เดือนนี้ ล่าสุด อย่างไร ยังไง อะไร ไหม มั้ย บ้าง ที่ไหน ไหน เมื่อไร เมื่อไหร่ หรือ หรือไม่ ครับ ค่ะ คะ จ้า เป็น มี ที่ ของ และ ใน กับ ได้
ให้ จะ ไป มา แล้ว ยัง ช่วย บอก หน่อย เกี่ยวกับ ข่าว เกิด ขึ้น อยู่ ตอน นี้ ไร ใคร ทำไม เท่าไร เท่าไหร่ กี่ แค่ไหน มาก ใหญ่ ล่ะ เข้า ออก ช่วง เรื่อง สถานการณ์ ข้อมูล รายงาน ใหม่ ขอ ไง ว่าไง อัปเดต
อัพเดท อัพเดต
""".split()
#: Words of the news, their other spellings, and the English words that sources have for them.
NEWS = {
    "น้ำท่วม": ["ท่วม", "flood"],
    "ท่วม": ["flood"],
    "กรุงเทพ": ["กทม", "กรุงฯ", "bangkok"],
    "กทม": ["กรุงเทพ", "bangkok"],
    "ราคา": ["price"],
    "ทองคำ": ["ทอง", "gold"],
    "ทอง": ["gold"],
    "น้ำมัน": ["oil"],
    "หุ้น": ["stock", "share"],
    "ดอกเบี้ย": ["interest rate", "rate"],
    "เงินเฟ้อ": ["inflation"],
    "ค่าเงิน": ["currency", "baht"],
    "บาท": ["baht"],
    "ดอลลาร์": ["dollar", "usd"],
    "แผ่นดินไหว": ["earthquake", "quake"],
    "พายุ": ["storm", "typhoon", "cyclone"],
    "ไต้ฝุ่น": ["typhoon"],
    "สึนามิ": ["tsunami"],
    "ฝนตก": ["ฝน", "rain"],
    "ฝน": ["rain"],
    "สภาพอากาศ": ["อากาศ", "weather"],
    "อากาศ": ["weather"],
    "อุณหภูมิ": ["temperature", "°c"],
    "ฝุ่น": ["pm2.5", "dust"],
    "ไฟไหม้": ["fire"],
    "ไฟป่า": ["wildfire"],
    "ภัยพิบัติ": ["disaster"],
    "โรคระบาด": ["ระบาด", "outbreak"],
    "ระบาด": ["outbreak"],
    "เลือกตั้ง": ["election"],
    "นายกรัฐมนตรี": ["นายกฯ", "prime minister"],
    "นายก": ["prime minister"],
    "รัฐบาล": ["government"],
    "ศาล": ["court"],
    "ธนาคารแห่งประเทศไทย": ["ธปท", "แบงก์ชาติ", "bank of thailand"],
    "แบงก์ชาติ": ["ธปท", "bank of thailand"],
    "ธนาคาร": ["bank"],
    "คริปโต": ["crypto"],
    "บิตคอยน์": ["bitcoin", "btc"],
    "แฮก": ["hack"],
    "ภูเขาไฟ": ["volcano"],
    "เศรษฐกิจ": ["economy"],
    "ส่งออก": ["export"],
    "ภาษี": ["tax", "tariff"],
    "ไทย": ["thailand", "thai"],
    "ประเทศไทย": ["ไทย", "thailand"],
    "เชียงใหม่": ["chiang mai"],
    "ปีใหม่": ["new year"],
    "ภูเก็ต": ["phuket"],
    "ขอนแก่น": ["khon kaen"],
    "หาดใหญ่": ["hat yai"],
    "พม่า": ["เมียนมา", "myanmar"],
    "เมียนมา": ["พม่า", "myanmar"],
    "กัมพูชา": ["cambodia"],
    "ลาว": ["laos"],
    "มาเลเซีย": ["malaysia"],
    "จีน": ["china"],
    "ญี่ปุ่น": ["japan"],
    "สหรัฐ": ["อเมริกา", "us", "united states"],
    "อเมริกา": ["สหรัฐ", "us"],
    "รัสเซีย": ["russia"],
    "ยูเครน": ["ukraine"],
    "อินเดีย": ["india"],
    "ยุโรป": ["europe", "eu"],
    "อพยพ": ["evacuat"],
    "เตือน": ["warning", "alert"],
    "รถไฟ": ["train", "rail"],
    "สนามบิน": ["airport"],
    "อุบัติเหตุ": ["accident"],
}
RUN = "[฀-๿]+"
#: A word of no more letters than this may be part of a longer one, and so counts only where a word is sure to begin.
SHORT = 3


def _pattern(known: list[str]) -> str:
    """A known word, the longest first; or letters up to where a long known word begins (short ones are found at the start of a run or after a known
    word alone, as the first choice is only tried there)."""
    of = lambda words: "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True)) or "(?!)"
    return f"(?:{of(known)})|(?:(?!{of([w for w in known if len(w) > SHORT])})[฀-๿])+"


TERMS = _pattern([*NEWS, *SHAPING])


def terms_of(text: str) -> list[str]:
    """The search terms in all Thai runs of a question: known words but for those that shape it, and what is between, of two letters at least."""
    got = [t for run in re.findall(RUN, text or "") for t in re.findall(TERMS, run)]
    return [t for t in got if t not in SHAPING and (t in NEWS or len(t) > 1)]


def terms(text: Column) -> Column:
    """The same for a column: an array of terms, empty for a null text."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(RUN), 0)
    got = F.flatten(F.transform(runs, lambda r: F.regexp_extract_all(r, F.lit(TERMS), 0)))
    return F.filter(got, lambda t: ~t.isin(SHAPING) & (t.isin(list(NEWS)) | (F.length(t) > 1)))


def forms(term: str) -> list[str]:
    return [term, *NEWS.get(term, [])]
