"""Stop words and settings that results depend on."""

from __future__ import annotations

# Korean stop words.
STOP_KO = frozenset(
    "이 가 을 를 은 는 에 의 와 과 도 로 으로 에서 까지 부터 에게 한테 이라 라 이며 며 이고 고 이나 나 이든 든 이랑 랑 하고 "
    "그리고 그러나 그런데 그래서 그러므로 따라서 하지만 또한 즉 왜냐하면 때문에 하여 하여서 이어서 게다가 뿐만 아니라 더불어 비롯한 "
    "이것 그것 저것 이런 그런 저런 여기 거기 이곳 저곳 우리 저 그 그녀 그들 각 모든 여러 어떤 각각 같은 다른 어느 무슨 "
    "있다 없다 하다 되다 이다 아니다 같다 보다 오다 가다 알다 모르다 크다 작다 많다 적다 좋다 나쁘다 "
    "매우 아주 너무 정말 꽤 다소 약간 거의 항상 자주 가끔 종종 이미 아직 바로 곧 여전히 더 덜 가장 훨씬 "
    "첫번째 두번째 세번째 번째 가지 개 통해 통한 대한 관한 위한 위해 방법 경우 다음 이후 이전 현재 기준 또는 혹은 예를 들어 예컨대".split()
)
# English stop words.
STOP_EN = frozenset(
    "a an the in on at by for with about against between into through during before after above below to from up down of off over under again out around upon "
    "and but or nor so yet both either neither not only whether although because since while if unless until when where as than that which who whom whose "
    "i me my myself we our ours ourselves you your yours yourself he him his she her hers it its they them their this that these those what each few more most other some such no any "
    "is are was were be been being have has had do does did can could will would shall should may might must ought "
    "very just also too now then here there often always never sometimes already still even however "
    "thus therefore hence moreover furthermore nevertheless consequently according based using used use one two three first second third".split()
)
# Words of programming languages, and names that code is full of.
STOP_CODE = frozenset(
    "false none true and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield "
    "abstract boolean byte case catch char const default do double enum extends final float goto implements instanceof int interface long native new package private protected public short static strictfp super switch synchronized this throw throws transient void volatile "
    "get set add remove create delete update init start stop run main test print input output read write open close load save send receive parse format convert check find search sort filter map list dict "
    "str bool type self cls obj val var tmp buf idx num cnt len size max min sum avg log err msg key value data info name path file dir src dst null undefined nan inf".split()
)
# Words that make no subject of a sentence built from a table row.
WEAK_SUBJECTS = ("종류", "역할", "유형", "방법", "방식", "예시", "형태", "구조", "개념", "의미", "목표", "단계", "절차", "기준", "조건", "결과", "항목", "내용", "요소", "성질")


def stop_words(language: str = "ko") -> frozenset[str]:
    """Stop words of ko, en or all."""
    sets = {"ko": STOP_KO, "en": STOP_EN, "all": STOP_KO | STOP_EN}
    if language not in sets:
        raise ValueError(f"unknown language {language!r}: ko, en or all")
    return sets[language]


def is_stop_word(word: str, language: str = "all") -> bool:
    return word.lower() in stop_words(language)
