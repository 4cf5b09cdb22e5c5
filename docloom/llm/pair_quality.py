"""Defects of question-answer pairs, by ordered rules.

The rules are column expressions: emptiness and placeholders, a copied
question, multilingual refusal phrases, unclosed delimiters, abrupt endings,
and a script or language that is not the question's. Abrupt endings are judged
against the corpus: how often its last word or characters end a clause there,
or have a few characters to go, counted over all answers. Every triggered defect is emitted, in the
rules' order; the first is the pair's defect.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce
from operator import or_

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.runtime import durable, latest, portions

#: Rules in order of precedence.
DEFECTS = ("empty", "copied", "refusal", "other_language", "truncated")

#: What stands for an answer that was never written, without marks and in lower case.
PLACEHOLDERS = ("null", "none", "nil", "nan", "na", "tbd", "tba", "tbc", "todo", "undefined", "unknown", "empty", "blank", "placeholder", "空", "略", "无", "無", "暂无", "暫無", "待补充", "待補充", "待定", "待更新", "未填", "未填写", "省略", "なし", "未定", "未記入", "entfällt", "keineangabe", "néant", "нет данных")

#: Tags that may precede a repeated question.
TAGS = "问|問|问题|問題|提问|答|回答|答案|q|a|question|answer|re|frage|antwort|質問|回答|вопрос|ответ|pergunta|pregunta"

#: The words of which declining is put together, by language: a negation, an act of speech or help,
#: the one who speaks, the one who asked, what was asked, and its bounds.
_ZH = {
    "NEG": r"(?:不能|不能够|无法|無法|不便|没法|沒法|没办法|没有办法|没有资格|没资格|没有权限|没权限|没有义务|不会|不會|不予|不可以|不方便|不具备|不好|无权|無權|难以|難以|难|不宜|不应|不该|不愿|不想|不打算|不准备|不肯|不得|拒绝|拒絕|谢绝|婉拒|暂不|概不|恕不|未获授权|未被授权|不被允许|不允许|不适合|不再|不)",
    "SAY": r"(?:回答|作答|答复|答覆|解答|应答|答话|奉告|置评|评论|透露|泄露|披露|告知|告诉|谈论|讨论|多说|多言|发表)",
    "HELP": r"(?:提供|给出|给予|给您|说明|解释|阐述|介绍|讲解|讲|说|谈|答|聊|分享|公开|协助|帮助|帮忙|帮|效劳|受理|处理|回应|响应|指导|建议|展开|满足|支持|配合)",
    "SELF": r"(?:我们|我方|我|本人|本助手|本系统|本客服|本机器人|小助手|助手|客服|在下|敝人|这边|小编|本平台|系统|平台)",
    "YOU": r"(?:您|你|用户|客户|提问者|大家|贵方)",
    "ASKED": r"(?:问题|提问|請求|请求|询问|咨询|疑问|话题|話題|要求|请托|这一点|这点|此事|此类|这类|这方面|该方面|上述方面|信息|细节|資訊|资讯|做法|内容|方法|资料|说法|答案|结论|意见)",
}
_EN = {
    "NEG": r"(?:cannot|can['’]?t|can not|could not|couldn['’]?t|won['’]?t|will not|would not|wouldn['’]?t|am not|['’]m not|are not|aren['’]?t|['’]re not|do not|don['’]?t|may not|must not|mustn['’]?t|shall not|should not|shouldn['’]?t|not able|unable|never|not allowed|not permitted|not authori[sz]ed|not in a position|not at liberty|not willing|unwilling|barred|prohibited|forbidden|prevented)",
    "SAY": r"(?:(?:answer|respond|reply|comment|discuss|reveal|say|tell|explain|elaborate|assist|help|offer|supply|talk|speak|address|cover|support|engage|fulfill?|walk)(?:ing)?|(?:disclos|divulg|shar|describ|provid|giv|advis|handl|guid|releas)(?:e|ing)|go(?:ing)? into|get(?:ting)? into|tak(?:e|ing) (?:on|up)|deal(?:ing)? with|weigh in|comply|do (?:that|this|so))",
}

#: Phrases that decline, in groups, each behind what it cannot do without.
REFUSALS = {
  r"[不无無没沒难難恕拒绝谢婉超抱歉憾]|请换": (
    # Chinese
    r"{NEG}(?:再)?[^，。；！？\n]{0,6}{SAY}(?!信号|报文|帧|器|机)",
    r"{SELF}[^，。；！？\n]{0,8}{NEG}[^，。；！？\n]{0,10}{HELP}[^，。；！？\n]{0,14}{ASKED}|(?:我们|我方|我|本人|本助手|本客服|小助手|在下)[^，。；！？\n]{0,8}{NEG}[^，。；！？\n]{0,6}{HELP}",
    r"{NEG}[^，。；！？\n]{0,4}(?:向|给|为|替|跟|对|帮){YOU}[^，。；！？\n]{0,8}(?:{SAY}|{HELP})|{NEG}(?:帮|帮助|协助){YOU}",
    r"{ASKED}[^，。；！？\n]{0,10}(?:超出|超过|超越|不在|不属于|不属|在[^，。]{0,8}之外)[^，。；！？\n]{0,16}(?:范围|範圍|范畴|能力|权限|职责|领域|业务|知识|内容|边界|之列|之内)",
    r"(?:超出|超过|不在|不属于)了?(?:我|本)[^，。；！？\n]{0,14}(?:范围|範圍|范畴|能力|权限|职责|领域|业务|知识|内容)|(?:超出|超过)我",
    r"(?:我|本人|我们|我方|本助手|助手|客服)[^，。；！？\n]{0,8}(?:拒绝|拒絕|谢绝|婉拒|无可奉告|爱莫能助|无能为力|无从(?:回答|作答|答复)|帮不)",
    r"恕(?:我|不|难|本|小)|无可奉告|爱莫能助|(?:这|此|该)(?:个|件|类|一)?(?:事|问题|请求|话题)?我?(?:们)?(?:答|帮|说|讲|办|解答|回答)不(?:了|出|上|来)|我[^，。；！？\n]{0,10}(?:答|帮|说|讲)不(?:了|出|上)",
    r"(?:抱歉|对不起|不好意思|遗憾|對不起|遺憾|见谅)[^。！!\n]{0,14}{NEG}[^。！!\n]{0,10}(?:{SAY}|{HELP}|{ASKED})|(?:抱歉|对不起|不好意思|遗憾)[，,]?(?:我|本人|我们)[^。！!\n]{0,6}{NEG}",
    r"作为[^。，,\n]{0,14}(?:模型|助手|助理|程序|机器人|客服|AI)[，,]?我?[^。\n]{0,6}(?:不|无|没|难)|(?:请|可以)?(?:换一?个|另换|改问)(?:问题|话题)",
  ),
  r"(?i)\b(?:I|we|me|my|us|our|sorry|afraid|regret|apolog\w+|polic\w+|guidelines?|unable|cannot|can['’]?t|not|no|ask|try)\b": (
    # English
    r"\b(?:I|we)\b[^.!?;\n]{0,30}?{NEGE}[^.!?;\n]{0,45}?\b{SAYE}\b",
    r"\b(?:I|we)(?:['’](?:ll|d|m|ve|re))?\b[^.!?;\n]{0,24}?\b(?:refuse|decline|declining|pass on|take a pass|pass(?=[.!]|$)|abstain|refrain from|withhold|rather not|prefer not|sooner not|better not|have no comment|leave (?:that|this|it|the \w+|your \w+) (?:unanswered|open|there|aside)|sit this one out|stay out of|reluctant to|hesitant to)\b",
    r"\b(?:not|outside|beyond|nothing|no)\b[^.!?;\n]{0,30}\b(?:I|we)(?:['’](?:m|re|ll))? (?:can|could|may|am|are|will|would|want to|wish to)?\b[^.!?;\n]{0,24}\b{SAYE}\b",
    r"\b(?:outside|beyond|out of|exceeds?|not within|not part of|not in|falls? outside|off)\b[^.!?;\n]{0,12}\b(?:my|our)\b",
    r"\b(?:against|violates?|contrary to) (?:my|our|the|company|internal) [^.!?;\n]{0,20}\b(?:polic|rule|guideline|instruction)|\b(?:polic(?:y|ies)|guidelines?|rules|instructions|regulations)\b[^.!?;\n]{0,24}\b(?:not|n['’]t|prevents?|prohibits?|forbids?|bars?|keeps?)\b[^.!?;\n]{0,24}\b(?:me|us|{SAYE})\b",
    r"\b(?:question|request|topic|query|enquiry|inquiry|details?|information|matter|subject|that|this|it)\b[^.!?;\n]{0,20}\b(?:cannot|can['’]?t|can not|will not|won['’]?t|may not|must not|is not (?:to )?|are not (?:to )?)\b ?(?:be )?(?:answered|disclosed|discussed|shared|revealed|given out|commented|addressed here|handled here|dealt with here)\b|\bno (?:comment|answer (?:can|will|is|may)\b|\w+ (?:from|by) (?:me|us)\b|\w+ from (?:my|our) side)|\bnot (?:able|willing|allowed|permitted|free|authori[sz]ed|at liberty|in a position|prepared) to {SAYE}\b",
    r"\b(?:sorry|apologies|apologi[sz]e|afraid|regret)\b[^.!?\n]{0,20}\b(?:I|we)\b[^.!?\n]{0,14}\b(?:not|unable|cannot|can['’]?t|won['’]?t|don['’]?t|must decline)\b|\b(?:unable|not able) to {SAYE} (?:you|this|that|your|any|with)\b",
    r"\bas an? [^.!?\n,]{0,30}(?:model|assistant|agent|AI|bot)\b[^.!?\n]{0,40}\b(?:not|n['’]t|cannot|unable|decline|refuse)\b|\b(?:ask|try) (?:me )?(?:something else|another question|a different question)\b",
  ),
  r"(?i)\b(?:ich|wir|mir|mich|uns|mein\w*|unser\w*|bedau\w+|keine)\b": (
    # German
    r"\btut (?:mir|uns) leid\b|\b(?:bedaure|bedauere|bedauern)\b|\b(?:ich|wir)\b[^.!?\n]{0,40}\b(?:nicht|nichts|keine?|keinen|keinerlei|nie)\b[^.!?\n]{0,30}\b(?:sagen|antworten|beantworten|helfen|mitteilen|erklären|erläutern|äußern|weitergeben|preisgeben|nennen|geben|machen|weiterhelfen|bearbeiten|eingehen|besprechen|zuständig|befugt|berechtigt)\b",
    r"\b(?:kann|darf|möchte|werde|will|können|dürfen|möchten|gebe|mache|erteile|sage|beantworte|bearbeite|behandle)\b (?:ich|wir)\b[^.!?\n]{0,40}\b(?:nicht|nichts|keine?|keinen|keinerlei)\b|\b(?:ich|wir) (?:gebe|mache|erteile|sage|beantworte|bearbeite|geben|machen|erteilen|sagen|kann|darf|möchte|können|dürfen)\b[^.!?\n]{0,40}\b(?:nicht|nichts|keine|keinerlei)\b",
    r"\b(?:ich|wir)\b[^.!?\n]{0,30}\b(?:ablehnen|verweigern|verweigere|überfragt|schweigen)\b|\blehnen? (?:ich|wir)\b|\b(?:ich|wir) (?:lehnen?|muss|müssen|verzichte)\b[^.!?\n]{0,40}\b(?:ab|ablehnen|passen|schweigen)\b|\b(?:außerhalb|jenseits) (?:meine[rs]?|unsere[rs]?)\b|\bübersteigt (?:meine?n?|unsere?n?)\b|\bkeine (?:Auskunft|Stellungnahme)\b|\bvon (?:mir|uns) keine?\b|\bfällt nicht in (?:mein|unser)",
  ),
  r"ません|ない|かね|控え|断り|遠慮|範囲|対象|拒|わけ|訳|じられ": (
    # Japanese
    r"(?:お?答え|お?応え|回答|返答|返信|説明|案内|提供|開示|公開|紹介|助言|手伝い|手助け|支援|サポート|協力|お伝え|お話し|お教え|申し上げ|教え|話す|扱|応じ|受け|コメント|言及|対応|お役に立)[^。！\n]{0,12}(?:できません|できない|出来ません|できかね|致しかね|いたしかね|しかね|かねます|られません|られない|えません|いたしません|しません|じられ|ことはでき|お断り|控え|差し控え|範囲外|対象外|わけには|訳には)",
    r"控えさせて|差し控え|お断り(?:し|いた|申)|ご?遠慮(?:し|させ|いた)|(?:お答え|回答|対応|サポート|担当|業務|案内)の?(?:できる)?(?:範囲|対象)(?:外|を超|ではあ|にあり)|申し訳[^。]{0,24}(?:ません|かね)[^。]{0,4}。?$|(?:拒否|拒絶)(?:し|いた)ます",
  ),
  r"(?i)\b(?:je|nous|désol\w+|regrett\w+|impossible|refus\w+|hors|dépasse|no|não|non|lo|mi|desculpe|sinto|lament\w+|fuera|xin|không|từ)\b|[А-Яа-я]|[가-힣]": (
    # French, Russian, Spanish, Portuguese, Italian, Vietnamese, Korean
    r"\b(?:désolée?s?|regrette|regrettons)\b|\b(?:je|nous)\b[^.!?\n]{0,12}\bn(?:e |['’])[^.!?\n]{0,24}\b(?:pas|rien|aucune?)\b[^.!?\n]{0,24}\b(?:répondre|aider|dire|donner|fournir|commenter|expliquer|communiquer|traiter|divulguer|partager|habilitée?|autorisée?|réponse)|\b(?:je|nous) (?:refus|déclin)|\b(?:impossible|refuse|refusons) de répondre|\bhors de (?:mon|ma|mes|notre)\b|\bdépasse (?:mon|ma|mes)\b",
    r"извини|прошу прощения|сожалени|\b(?:я|мы)\b[^.!?\n]{0,20}\bне\b[^.!?\n]{0,24}(?:отве|помо|сказа|да(?:ть|ю|ём)|обсуж|комментир|раскры|сообщ|объясн|предостав)|не (?:могу|можем) (?:ответить|помочь|сказать|дать|обсуждать|раскрыть)|не (?:имею|имеем|вправе)|отказыва(?:юсь|емся)|вне моей|за рамк",
    r"\b(?:lo siento|lo sentimos|lamento|lamentamos)\b|\bno (?:puedo|podemos|debo|quiero|estoy autorizad[oa]|me es posible)\b[^.!?\n]{0,20}\b(?:responder|ayudar|dar|proporcionar|decir|comentar|compartir|explicar|facilitar|contestar|revelar)|\bfuera de mi\b|\b(?:desculpe|sinto muito|lamento)\b|\bnão (?:posso|podemos|devo|quero)\b[^.!?\n]{0,20}\b(?:responder|ajudar|dar|fornecer|dizer|comentar|partilhar|explicar)|\bmi (?:dispiace|spiace)\b|\bnon (?:posso|possiamo)\b[^.!?\n]{0,20}\b(?:rispondere|aiutare|dare|fornire|dire|commentare)",
    r"\bxin lỗi\b|không thể (?:trả lời|giúp|cung cấp|tiết lộ|hỗ trợ|chia sẻ)|từ chối trả lời|(?:죄송|유감)|(?:답변|대답|말씀|설명|도와|제공|공개)[^.!?\n]{0,12}(?:수 없|못|어렵|불가|거절|거부)",
  ),
}

#: What is declined is only an exact value, or nothing at all, where the answer then goes on.
_HEDGED = r"\b(?:cannot|can['’]?t|can not|not possible to|do not|don['’]?t|won['’]?t|will not) (?:give|state|quote|name|offer|provide|say|tell) (?:\w+ )?(?:an? |any |one |the )?(?:single |universal |general |exactly|precisely|for sure|fixed|exact|precise|firm|definite|specific|set|standard|accurate)(?: \w+)?|(?:无法|不能|难以|没法)(?:给出|提供|说明|说出)[^，。；]{0,4}(?:固定|统一|准确|精确|确切|具体|唯一|通用)[^，。；]{0,6}|\bkeine[n]? (?:festen?|genauen?|exakten?|pauschalen?) \w+"


def _pattern(of: str) -> str:
    for name, words in _ZH.items():
        of = of.replace("{" + name + "}", words)
    return of.replace("{NEGE}", _EN["NEG"]).replace("{SAYE}", _EN["SAY"])


def declines(answer: Column) -> Column:
    """Whether an answer declines.

    Declining is put together from a negation, an act of speech or help, and
    the one who speaks or asked, so that wordings need no list. To refuse an
    exact value and go on with one (a number behind it) is no refusal.
    """
    rest = F.regexp_replace(answer, rf"(?iu){_HEDGED}(?=[^\n]*\d)", " ")
    found = [rest.rlike(guard) & rest.rlike("(?iu)" + "|".join(f"(?:{_pattern(p)})" for p in group)) for guard, group in REFUSALS.items()]
    return reduce(or_, found)


#: Words, and ends of text in scripts without spaces, that cannot be the last of a statement,
#: and connectives that cannot be all of its last clause.
HANGING_WORDS = "and or but because if when while than the an of to with from by for into between as its whose which until unless although via per during against towards my our your every und oder weil wenn dass sowie die der das den dem ein eine mit et ou mais parce que le les un une des du de avec dans pour и или но если потому что"
HANGING_PARTS = "因为 以及 并且 而且 如果 或者 但是 不过 所以 由于 和 与 或 及 但 而 的 比 到 至 则 把 被 および または かつ なので ので、 が、 を の"
HANGING_CLAUSES = "其中 因此 此外 另外 同时 然后 随后 接着 最后 首先 其次 例如 比如 包括 尤其 特别是 从而 进而 于是 否则 若 当 在 即 且 并 此时 这时 期间 必要时 以便 以免 直至 直到 除非 只要 只有 即使 虽然 尽管 ただし そして しかし また さらに 例えば そのため なお however therefore otherwise then also moreover furthermore meanwhile finally jedoch deshalb außerdem danach sonst"

#: Frequent short words of languages written in Latin letters.
WORDS = {
    "en": "the a an is are it its of to in on at and or if before after with for not when then than what how why does which should must i you stay stays once by from this that be can do your any all no only more less each every also them they we there here over under up down out off into until while during about",
    "de": "der die das den dem des ein eine und oder ist sind wird bei vor nach mit ohne für auf zu zur zum gemäß jede was tun wenn weil nicht während außerhalb dem im wie warum von an",
    "fr": "le la les un une des du de et ou est sont à au aux dans sur sans pour par avec après dès où ce cette qui que ne pas quand l d c comment pourquoi",
    "es": "el los las una unos del y es son en con sin por para cuando que no se lo al como qué está",
    "pt": "o os as um uma do da dos das e é são em no na com sem por para quando que não se ao à como está",
    "it": "il lo gli una del della dei e è sono in nel nella con senza per quando che non si al alla come",
    "vi": "và là của các một những trong khi cho không được với để này có bị sau trước bằng",
    "nl": "het een van en niet voor naar bij zijn wordt met aan ook dan deze dat moet tegen zonder tussen uit wordt",
    "pl": "jest nie się na po przed przez oraz dla jako który która które są być przy lub bez pod aby od tylko czy jak",
    "cs": "je se na po před pro jako který která které jsou být nebo bez pod aby od ale při není když podle",
    "tr": "ve bir bu için ile olarak değil gibi daha sonra önce kadar ya veya her çok olan ise ne en",
    "id": "yang dan di untuk dengan tidak dari pada ini itu akan adalah atau sebelum sesudah setelah harus ke oleh jika",
    "sv": "och är att det som på för av med den till inte ett om från eller har kan ska innan efter vid",
    "da": "og er at det som på for af med den til ikke et om fra eller har kan skal før efter ved",
    "fi": "ja on ei se että kun tai ennen jälkeen kanssa ole ovat mutta jos vain myös sekä niin",
    "hu": "a az és nem egy hogy van vagy után előtt kell meg csak is ha akkor mint ez legyen",
    "ro": "și este nu în cu pe pentru la sau după înainte fără care din sunt dacă trebuie mai prin când",
    "sw": "na ya wa kwa ni la katika kabla baada au hii hiyo bila cha za kama lazima hadi",
}

_LETTERS = {"han": r"\p{IsHan}", "kana": r"\p{IsHiragana}\p{IsKatakana}", "hangul": r"\p{IsHangul}", "cyrillic": r"\p{IsCyrillic}", "thai": r"\p{IsThai}", "arabic": r"\p{IsArabic}", "greek": r"\p{IsGreek}", "hebrew": r"\p{IsHebrew}", "more": "".join(rf"\p{{Is{x}}}" for x in "Devanagari Bengali Gurmukhi Gujarati Tamil Telugu Kannada Malayalam Sinhala Lao Tibetan Myanmar Georgian Ethiopic Khmer Mongolian Armenian".split()), "latin": r"\p{IsLatin}"}

_FULLWIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_ASCII = "".join(chr(c) for c in range(0x21, 0x7F))


def _plain(x: Column) -> Column:
    """Letters and digits only, half width, lower case."""
    return F.regexp_replace(F.lower(F.translate(x, _FULLWIDTH, _ASCII)), r"[^\p{L}\p{N}]+", "")


def _prose(x: Column) -> Column:
    """Without code, quoted terms, links, codes of parts and numbers with units."""
    for pattern in (r"(?s)```.*?(```|$)", r"`[^`]*`", r"!?\[[^\]]*\]\([^)]*\)", r"https?://\S+", r"“[^”]*”|\"[^\"]*\"|「[^」]*」|『[^』]*』|«[^»]*»", r"\b[A-Z]{1,4}-?\d[\w/.-]*", r"[±+-]?\d[\d.,]*\s*[A-Za-z°µΩ%·/²³]{0,7}"):
        x = F.regexp_replace(x, pattern, " ")
    return x


def _count(x: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(x, f"[^{chars}]", ""))


def with_language(df: DataFrame, text: str, out: str, brief: bool = False) -> DataFrame:
    """Add the language of running text: a script's, or one by its frequent words; null where too little tells.

    Two frequent words at least must tell, or with ``brief`` one that no other language has, in a text of at most six words.

    Built in steps, each a column of its own, so that no expression is
    evaluated once per use.
    """
    prose = f"{out}__prose"
    df = df.withColumn(prose, _prose(F.col(text)))
    rare = [k for k in _LETTERS if k not in ("han", "kana", "latin")]
    odd = F.col(prose).rlike("[" + "".join(_LETTERS[k] for k in rare) + "]")
    counts = {k: F.when(odd, _count(F.col(prose), v)).otherwise(0) if k in rare else _count(F.col(prose), v) for k, v in _LETTERS.items()}
    df = df.withColumns({f"{out}__{k}": c for k, c in counts.items()} | {f"{out}__words": F.array_remove(F.split(F.lower(F.regexp_replace(prose, r"[^\p{IsLatin}\p{M}]+", " ")), " "), "")})

    def hit(own: str) -> Column:
        return F.size(F.filter(f"{out}__words", lambda w: w.isin(own.split())))

    n = {k: F.col(f"{out}__{k}") for k in _LETTERS}
    hits = F.when(n["latin"] >= 2, F.sort_array(F.array(*[F.struct(hit(own).alias("n"), F.lit(k).alias("k")) for k, own in WORDS.items()]), asc=False))
    df = df.withColumn(f"{out}__hits", hits)
    ranked = F.col(f"{out}__hits")
    enough = ranked[0]["n"] >= 2
    if brief:
        enough = enough | (ranked[0]["n"] == 1) & (F.size(f"{out}__words") <= 6)
    latin = F.when(enough & (ranked[0]["n"] > ranked[1]["n"]), ranked[0]["k"])
    other = F.when(n["more"] >= 3, "other").when(n["hangul"] >= 2, "ko").when(n["cyrillic"] >= 4, "ru").when(n["thai"] >= 4, "th").when(n["arabic"] >= 4, "ar").when(n["hebrew"] >= 4, "he").when(n["greek"] >= 4, "el")
    strong = F.greatest(*[n[k] for k in rare])
    cjk = n["han"] + n["kana"]
    found = (
        F.when((n["kana"] >= 2) & (n["kana"] * 5 >= cjk) & (cjk * 4 >= n["latin"]), "ja")
        .when((n["han"] >= 1) & (n["han"] * 4 >= n["latin"]) & (n["han"] >= strong), "zh")
        .when(strong * 2 >= n["latin"], F.coalesce(other, latin))
        .otherwise(latin)
    )
    # running text in Latin letters, whatever its language: enough words, most of them small
    small = F.size(F.filter(F.split(F.regexp_replace(prose, r"[^\p{L}\p{M}'’]+", " "), " "), lambda w: w.rlike(r"^\p{Ll}[\p{L}\p{M}'’]*$")))
    strange = F.size(F.filter(f"{out}__words", lambda w: w.rlike(r"[^\x00-\x7F]")))
    df = df.withColumn(f"{out}_latin", F.when(n["latin"] > 4 * (cjk + strong), small).otherwise(0)).withColumn(f"{out}_strange", strange)
    df = df.withColumn(f"{out}_own", F.transform(F.col(f"{out}__hits"), lambda h: F.struct(h.k.alias("k"), h.n.alias("n"))))
    return df.withColumn(out, found).drop(prose, f"{out}__words", f"{out}__hits", *[f"{out}__{k}" for k in _LETTERS])


def _unclosed(x: Column, outside: Column) -> Column:
    """Whether a bracket, quotation, code fence or table row opens and never closes."""

    def more(opening: str, closing: str) -> Column:
        return F.length(F.regexp_replace(x, f"[^{opening}]", "")) > F.length(F.regexp_replace(x, f"[^{closing}]", ""))

    fences = F.size(F.split(x, "```")) % 2 == 0
    last = F.regexp_extract(x, r"(?s)(?:^|\n)[ \t]*(\|[^\n]*)$", 1)
    head = F.regexp_extract(x, r"(\|[^\n]*)\n[ \t]*\|[ :|-]*-", 1)
    bars = lambda s: F.length(F.regexp_replace(s, r"[^|]", ""))
    row = (last != "") & ~F.rtrim(last).rlike(r"\|$") | (last != "") & (head != "") & (bars(last) < bars(head))
    brackets = more(r"(（", r")）") | more(r"\[【", r"\]】") | more("“", "”") | more("「", "」") | more("『", "』") | more("《", "》") | more("„", "“”")
    straight = F.length(F.regexp_replace(F.regexp_replace(outside, r"\d\s?\"", ""), r"[^\"]", "")) % 2 == 1
    return fences | row | brackets | straight | (F.length(F.regexp_replace(outside, r"[^`]", "")) % 2 == 1)


#: A clause ends before these.
_ENDS = "。．.！!？?；;，,、：:\n\r)）」』”\"|"

_CJK = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー]"
_WORD = r"(?:(?![\p{IsHan}\p{IsHiragana}\p{IsKatakana}])[\p{L}\p{M}'’])+"

#: Longer runs of letters are no words.
WORD_MAX = 100
#: Characters behind a unit within which a clause may end "soon".
SOON = 3

COUNTED = ("seen", "ended", "soon", "bare")
_UNITS = "unit string, seen long, ended long, soon long, bare long"


@lru_cache(maxsize=1)
def _unspaced() -> np.ndarray:
    """Whether a code point belongs to the scripts without spaces."""
    out = np.zeros(0x110000, bool)
    plane = "".join(map(chr, range(0x3000, 0xD800))) + "".join(map(chr, range(0xF900, 0x10000)))
    out[[ord(x) for x in regex.findall(r"[\p{Han}\p{Hiragana}\p{Katakana}ー]", plane)]] = True
    out[0x20000:0x32000] = True
    return out


_RUN = regex.compile(r"(?:(?![\p{Han}\p{Hiragana}\p{Katakana}])[\p{L}\p{M}'’])+")


#: Characters that are counted at once.
TOGETHER = 2_000_000


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[str]]:
    for batch in batches:
        texts = [x for x in batch.column(0).to_pylist() if x]
        for i, j in portions([len(x) for x in texts], TOGETHER):
            yield texts[i:j]


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units of the texts of a batch that something follows, how many of them end a clause or do so soon.

    Units are words, pairs of words, and one to three characters of scripts
    without spaces. Those at a text's bare end are counted apart.
    """
    marks = np.zeros(0x110000, bool)
    marks[[ord(c) for c in _ENDS]] = True
    for texts in _texts(batches):
        whole = "\0" + "\0".join(texts) + "\0" * (SOON + 5)
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        own, mark = _unspaced()[codes], marks[codes]
        after = np.where(codes[:-1] == 32, codes[1:], codes[:-1])  # what stands at a place, one blank aside
        ended, seen = marks[after], after != 0
        units, counts = [], []
        n = len(codes) - SOON - 4
        for k in (1, 2, 3):
            at = np.flatnonzero(reduce(np.logical_and, [own[i : n + i] for i in range(k)]))
            key = reduce(lambda x, i: x << 21 | codes[at + i], range(1, k), codes[at])
            soon, run = np.zeros(len(at), bool), np.ones(len(at), bool)
            for j in range(SOON):
                run &= own[at + k + j]
                soon |= run & mark[at + k + j + 1]
            names, place = np.unique(key, return_inverse=True)
            units += ["".join(chr(x >> 21 * (k - 1 - i) & 0x1FFFFF) for i in range(k)) for x in names.tolist()]
            counts.append(np.stack([np.bincount(place, w, len(names)) for w in (seen[at + k], ended[at + k], soon & ~ended[at + k], ~seen[at + k])]))
        words: Counter = Counter()  # by what follows: 0 something, 1 the end of a clause, 2 nothing
        last, stop = "", -1
        for m in _RUN.finditer(whole):
            i, j = m.span()
            if j - i > WORD_MAX:
                continue
            word = m.group().lower()
            end = 2 if not seen[j] else int(ended[j])
            words[word, end] += 1
            if i == stop + 1 and whole[stop] == " ":
                words[f"{last} {word}", end] += 1
            last, stop = word, j
        spelled = sorted({w for w, _ in words})
        units += spelled
        counts.append(np.array([[words[w, 0] + words[w, 1], words[w, 1], 0, words[w, 2]] for w in spelled], float).reshape(-1, 4).T)
        total = np.concatenate(counts, axis=1).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(units, pa.string()), *(pa.array(x) for x in total)], names=["unit", *COUNTED])


def endings(texts: DataFrame, text: str = "text") -> DataFrame:
    """By unit, over all texts: ``seen`` with something behind it, ``ended`` a clause, ``soon`` did with at most ``SOON`` characters to go, ``bare`` at a text's end."""
    return texts.select(text).mapInArrow(_tally, _UNITS).groupBy("unit").agg(*[F.sum(c).alias(c) for c in COUNTED])


def flag_pairs(df: DataFrame, key: str = "pair_id", question: str = "question", answer: str = "answer", order: str | None = "ingested_at") -> DataFrame:
    """Each defective pair: key, ``defect`` (the first by precedence) and ``defects`` (all triggered, in order).

    A pair delivered again counts once, as delivered last; pairs with a null key
    are one pair. A null answer is empty; a null question can be neither copied
    nor set the language. Sound pairs give no row. Other columns are ignored,
    whatever their names.
    """
    order = order if order in df.columns else None
    slim = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{question}`").alias("q"), F.col(f"`{answer}`").alias("a"), *([F.col(f"`{order}`").alias("at")] if order else []))
    pairs = durable(latest(slim, ["key"], "at" if order else None).select("key", F.regexp_replace(F.coalesce("q", F.lit("")), r"^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$", "").alias("q"), F.regexp_replace(F.coalesce("a", F.lit("")), r"^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$", "").alias("a")))
    staged = with_language(with_language(pairs, "q", "lq", brief=True), "a", "la")
    q, a = F.col("q"), F.col("a")
    staged = staged.withColumns({
        "said": _plain(F.regexp_replace(a, r"(?i)<br\s*/?>|&nbsp;|</?[a-z]{1,10}\s*/?>", "")),
        "told": _plain(F.regexp_replace(a, rf"(?im)^[\s>#*\-]*(?:{TAGS})\s*[:：.．]\s*", "")),
        "asked": _plain(q),
        "short": a.rlike(rf"^{_CJK}{{1,4}}$|^{_WORD}( {_WORD}){{0,2}}$"),
        "measure": a.rlike(rf"(^|[^\p{{IsLatin}}\d.,-])[±+-]?[\d.,]*\d\s?([\p{{IsLatin}}\p{{IsGreek}}°%·/²³]{{1,7}}|{_CJK}{{1,4}})$"),
        "outside": F.regexp_replace(a, r"(?s)```.*?```", " "),
    })
    empty = (F.col("said") == "") | F.col("said").isin(*PLACEHOLDERS)
    copied = (F.col("asked") != "") & (F.replace("told", F.col("asked"), F.lit("")) == "") & ~empty
    refusal = declines(F.when(q != "", F.replace(a, q, F.lit(" "))).otherwise(a))
    latin_asked = F.col("lq").isin(*WORDS)
    own_words = F.coalesce(F.get(F.filter("la_own", lambda h: h.k == F.col("lq")), F.lit(0))["n"], F.lit(0))
    # a language without a word list: another script, letters foreign to the question's language, or none of its common words
    script = F.col("lq").isNotNull() & ~latin_asked & (F.col("la_latin") >= 3) & (F.size("la_own") > 0)
    foreign = latin_asked & F.col("la").isNull() & (own_words == 0) & ((F.col("la_latin") >= 8) | (F.col("la_latin") >= 4) & (F.col("la_strange") >= 2))
    other = (F.col("lq").isNotNull() & F.col("la").isNotNull() & (F.col("lq") != F.col("la"))) | (F.col("la").isNull() & script) | foreign
    hanging = a.rlike(r"([，,、：:×～~＋+=≤≥<（(\[【“「《–—&]|(?<!-)-(?!-))$") | a.rlike(r"(的)?[^，。；,;\s]{1,8}比[^，。；高低大小多少长短快慢强弱好差]{1,10}$")
    hanging = hanging | a.rlike(rf"(?iu)(?<![\p{{L}}])({'|'.join(HANGING_WORDS.split())})$|({'|'.join(HANGING_PARTS.split())})$|[，,；;。.:：\n]\s*({'|'.join(HANGING_CLAUSES.split())})$")
    open_end = ~F.col("short") & ~F.col("measure") & ~a.rlike(r"[。．.！!？?…）)”\"」』|`;；]$")
    cut, context = (F.lower(F.when(open_end, F.regexp_extract(F.right(a, F.lit(2 * WORD_MAX + 2)), rf"({unit})$", 1)).otherwise("")) for unit in (rf"{_WORD}|{_CJK}{{2}}", rf"{_WORD} {_WORD}|{_CJK}{{3}}"))
    lone = F.when(cut.rlike(rf"^{_CJK}{{2}}$"), F.substring(cut, 2, 1)).otherwise("")
    marked = staged.select("key", empty.alias("empty"), copied.alias("copied"), refusal.alias("refusal"), other.alias("other"), ((hanging & ~F.col("short")) | _unclosed(a, F.col("outside"))).alias("broken"), cut.alias("cut"), context.alias("context"), lone.alias("lone"))
    marked = durable(marked)
    known = durable(endings(pairs, "a"))
    asked_for = marked.filter("cut <> ''").select("cut", "context", "lone").distinct()
    near = known.select(F.col("unit").alias("cut"), *COUNTED)
    wide = known.select(F.col("unit").alias("context"), *[F.col(c).alias(f"wide_{c}") for c in COUNTED])
    single = known.filter(F.length("unit") == 1).select(F.col("unit").alias("lone"), F.col("seen").alias("lone_seen"), F.col("ended").alias("lone_ended"))
    stems = known.filter((F.col("seen") >= 3) & (F.length("unit") > 2) & F.col("unit").rlike(r"^[\p{IsLatin}\p{IsCyrillic}'’]+$"))
    stems = stems.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("unit") - 1), lambda i: F.substring("unit", F.lit(1), i))).alias("cut")).distinct().withColumn("stem", F.lit(True))
    counts = asked_for.join(near, "cut", "left").join(wide, "context", "left").join(single, "lone", "left").join(stems, "cut", "left")
    counts = counts.fillna(0, [*COUNTED, *(f"wide_{c}" for c in COUNTED), "lone_seen", "lone_ended"])
    never = (F.col("seen") >= 5) & (F.col("ended") * 100 < F.col("seen")) & ~((F.col("wide_ended") >= 2) & (F.col("wide_ended") * 5 >= F.col("wide_seen")))
    spaced = F.col("cut").rlike(r"^[\p{IsLatin}\p{IsCyrillic}'’]+$")
    never = never | (spaced & (F.col("wide_seen") >= 5) & (F.col("wide_ended") * 100 < F.col("wide_seen")))
    unseen = (F.col("seen") < 3) & (F.col("ended") == 0) & (F.coalesce("stem", F.lit(False)) | (F.col("seen") == 0))
    stub = (F.length("cut") <= 2) & (F.col("context") != "") & (F.col("wide_seen") == 0)
    unknown = spaced & (unseen | stub)
    # scripts without spaces: the end is inside a word if it never ended a clause but mostly had a few characters to go,
    # or if its last character alone hardly ever ends one
    inside = (F.col("ended") == 0) & (F.col("wide_ended") == 0) & (F.col("seen") >= 2) & (F.col("soon") * 2 >= F.col("seen"))
    bound = (F.col("lone") != "") & (F.col("ended") == 0) & (F.col("lone_seen") >= 20) & (F.col("lone_ended") * F.when(F.col("seen") > 0, 50).otherwise(200) < F.col("lone_seen"))
    # answers break off anywhere, so what stands at many bare ends for its number is an ending of its own
    usual = F.col("bare") * 5 > F.col("seen") + 10
    judged = counts.select("cut", "context", (unknown | ((never | (~spaced & inside) | bound) & ~usual)).alias("abrupt"))
    # most answers end with a mark and have nothing to look up: they must not meet under one empty key
    open_ended, closed = marked.filter("cut <> ''"), marked.filter("cut = ''")
    flagged = open_ended.join(judged, ["cut", "context"], "left").unionByName(closed.withColumn("abrupt", F.lit(False)))
    truncated = F.col("broken") | F.coalesce("abrupt", F.lit(False))
    names = F.filter(F.array(F.when(F.col("empty"), "empty"), F.when(F.col("copied"), "copied"), F.when(F.col("refusal"), "refusal"), F.when(F.col("other") & ~F.col("empty"), "other_language"), F.when(truncated & ~F.col("empty"), "truncated")), lambda x: x.isNotNull())
    return flagged.select(F.col("key").alias(key), names.alias("defects")).filter(F.size("defects") > 0).select(key, F.col("defects")[0].alias("defect"), "defects")
