"""Rule catalogs: flags by pattern, noisy-OR risk, explanations.

A catalog is a list of (flag, patterns, weight, explanation).  Patterns match without regard to case, in Unicode; a flag is
found if any of its patterns is; flags come in catalog order.  All is one projection without a UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Catalog = list[tuple[str, list[str], float, str]]
DEFAULT_WEIGHT = 0.5

#: The catalog for calls in Russian and Kazakh; fixed values.
CALLS: Catalog = [
    ("sms_code_request", [
        r"продиктуйте\s+код", r"назовите\s+код", r"код\s+из\s+(смс|sms|сообщени)", r"(четыре|4)\s+цифр\w*\s+из\s+(смс|sms|сообщени)",
        r"код\s+подтверждени\w*\s+(из|с)\s+", r"скажите\s+код", r"диктуйте\s+код", r"кодты\s+айты\w*", r"sms-т[еі]\w*\s+код\w*\s+айты",
        r"растау\s+код\w*\s+айты", r"хабарламадағы\s+(төрт|4)\s+сан",
    ], 0.95, "Просят назвать код из SMS"),
    ("safe_account", [
        r"безопасн\w*\s+счёт", r"безопасн\w*\s+счет", r"резервн\w*\s+счёт", r"резервн\w*\s+счет", r"специальн\w*\s+счёт", r"страхов\w*\s+счёт",
        r"қауіпсіз\s+шот", r"резервтік\s+шот",
    ], 0.95, "Предлагают перевести на «безопасный счёт»"),
    ("remote_access_request", [
        r"anydesk", r"teamviewer", r"rustdesk", r"quicksupport", r"установите\s+(приложени|программ)\w*\s+(для\s+)?(удал[её]нн|поддержк)",
        r"программ\w*\s+удал[её]нн\w*\s+доступ", r"қашықтан\s+қолдау\s+қосымша", r"қосымшасын\s+орнаты",
    ], 0.93, "Просят установить программу удалённого доступа"),
    ("screen_share_request", [r"демонстраци\w*\s+экран", r"покажите\s+экран", r"включите\s+показ\s+экран", r"экранды\s+көрсету"], 0.90, "Просят включить демонстрацию экрана"),
    ("keep_line_open", [
        r"не\s+кладите\s+трубку", r"не\s+вешайте\s+трубку", r"лини\w*\s+должна\s+оставаться", r"оставайтесь\s+на\s+линии",
        r"не\s+прерывайте\s+(разговор|звонок)", r"телефонды\s+қоймаңыз", r"желі\s+ашық\s+тұруы",
    ], 0.88, "Требуют не класть трубку"),
    ("secrecy_demand", [
        r"никому\s+не\s+(сообщ|говор|рассказ)\w*", r"не\s+(говори|говорите|рассказывай|рассказывайте)\w*\s+(пока\s+)?(никому|маме|папе|жене|мужу|родным)",
        r"(маме|папе|жене|мужу|родным)\s+(пока\s+)?не\s+говори\w*", r"это\s+конфиденциальн\w*\s+информаци\w*,?\s+не", r"не\s+звони\w*\s+никому",
        r"ешкімге\s+айтпа", r"анама\s+айтпа", r"әзірше\s+айтпа",
    ], 0.85, "Требуют никому не рассказывать"),
    ("actor_handoff", [
        r"соединяю\s+вас\s+с", r"сейчас\s+с\s+вами\s+будет\s+говорить", r"перевожу\s+на\s+(следовател|специалист|сотрудник)",
        r"это\s+(старший\s+)?лейтенант", r"тергеуші(мен)?\s+байланыстыр",
    ], 0.80, "Передают разговор «сотруднику органов»"),
    ("guaranteed_returns", [
        r"доход\w*\s+гарантирован", r"гарантированн\w*\s+(доход|прибыл)", r"риска?\s+(практически\s+)?нет", r"без\s+риска",
        r"кіріс\w*\s+кепілдендірілген", r"тәуекел\s+жоқ",
    ], 0.85, "Обещают доход без риска"),
    ("unrequested_loan", [
        r"на\s+ва(ше|с)\s+имя\s+(пытаются\s+)?оформ\w*\s+кредит", r"подана\s+заявка\s+на\s+кредит", r"оформляют\s+кредит",
        r"заявк\w*\s+на\s+кредит\s+одобрен", r"атыңызға\s+несие", r"несиеге\s+өтінім",
    ], 0.75, "Речь о кредите, который вы не оформляли"),
    ("time_pressure", [
        r"у\s+(вас|нас)\s+(осталось\s+)?(две|пять|десять|\d+)\s+минут", r"сейчас\s+заблокиру\w*", r"успеть\s+(сейчас|до)", r"иначе\s+будет\s+поздно",
        r"в\s+течение\s+суток", r"до\s+конца\s+(рабочего\s+дня|квартала)", r"мест\s+осталось", r"набор\s+закрыва\w*", r"уақыт\s+бар",
        r"үлгеру\s+керек", r"орын\s+аз\s+қалды",
    ], 0.70, "Искусственный дефицит времени"),
    ("credential_harvesting", [
        r"(введите|укажите|назовите|продиктуйте)\s+(номер\s+)?(удостоверени|иин|карт)", r"данные\s+карты", r"срок\s+действия\s+карты", r"cvv",
        r"жеке\s+куәлік\s+нөмір", r"карта\s+деректер",
    ], 0.85, "Запрашивают данные карты или удостоверения"),
    ("unsolicited_link", [
        r"перейдите\s+по\s+ссылк", r"подтвердите[:\s]+http", r"проверьте[:\s]+http", r"сілтеме\s+арқылы", r"сілтемеге\s+өт",
    ], 0.70, "Присылают ссылку без вашего запроса"),
    ("no_callback_possible", [
        r"перезвонить\s+не\s+(смогу|могу)", r"телефон\s+(сейчас\s+)?(сядет|отключится|разряд)", r"не\s+перезванивайте",
        r"қайта\s+қоңырау\s+шала\s+алмаймын", r"телефон\s+өшеді",
    ], 0.75, "Утверждают, что перезвонить нельзя"),
    ("emotional_urgency", [
        r"попал\s+в\s+авари", r"меня\s+задержали", r"нужны\s+деньги\s+срочно", r"прямо\s+сейчас,?\s+потом\s+объясню", r"тут\s+вс[её]\s+сложно",
        r"жол\s+апатына", r"ұстап\s+алды", r"қазір\s+аудар",
    ], 0.65, "Давят на эмоции и срочность"),
    ("exit_fee_trap", [
        r"для\s+вывода\s+нужно", r"оплатить\s+налог", r"подтверждающ\w*\s+взнос", r"комисси\w*\s+для\s+вывода", r"шығару\s+үшін\s+.*төлеу", r"растау\s+жарнас",
    ], 0.80, "Для вывода прибыли требуют доплату"),
    ("scarcity_pressure", [
        r"мест\s+(осталось\s+)?немного", r"закрываем\s+сегодня", r"специальн\w*\s+ставк\w*\s+сейчас", r"акци\w*\s+(заканчива|действует\s+до)",
        r"услови\w*\s+.*действуют\s+до", r"орын\s+аз", r"акция\s+ай\s+соңында",
    ], 0.60, "«Мест мало, решайте сейчас»"),
    ("service_disconnection_threat", [
        r"номер\s+будет\s+отключ", r"доступ\s+будет\s+(закрыт|ограничен)", r"передан\s+другому\s+абонент", r"услуга\s+будет\s+(приостановлен|отключен)",
        r"(запись|заявк\w*)\s+.*автоматически\s+(снимет|аннулир)", r"нөмір\s+.*өшіріледі", r"қызмет\s+тоқтатылады",
    ], 0.65, "Угрожают отключить услугу"),
    ("device_lockout", [r"телефон\s+может\s+.*заблокир", r"не\s+перезагружайте\s+устройство", r"телефон\s+уақытша\s+бұғатта"], 0.90, "Предупреждают о блокировке устройства"),
    ("benefit_lure", [
        r"вам\s+положен\w*\s+(перерасч[её]т|доплат|выплат)", r"неучт[её]нн\w*\s+стаж", r"скидк\w*\s+\d+\s*%", r"действует\s+скидк",
        r"есепке\s+алынбаған\s+еңбек", r"жеңілдік",
    ], 0.55, "Обещают выплату или льготу"),
    ("manufactured_urgency", [
        r"атака\s+продолжается", r"массов\w*\s+(smsс|смс|sms)[-\s]?атак", r"попытка\s+взлома", r"жаппай\s+sms", r"шабуыл\s+жалғасуда",
    ], 0.70, "Срочность создана самими звонящими"),
]

#: The catalog for the test tables: words of their toxic documents and two broader patterns.
TABLES: Catalog = [
    ("idiot", ["idiot"], 0.7, "insult"), ("moron", ["moron"], 0.7, "insult"), ("loser", ["loser"], 0.7, "insult"), ("clown", ["clown"], 0.7, "insult"),
    ("scum", ["scum"], 0.65, "contempt"), ("trash", ["trash"], 0.65, "contempt"), ("worthless", ["worthless"], 0.55, "belittling"), ("pathetic", ["pathetic"], 0.55, "belittling"),
    ("digits", ["[0-9]{3}"], 0.6, "a number"), ("legal", ["license", "copyright"], 0.65, "a licence"),
]


def detect(text: Column, catalog: Catalog) -> Column:
    """The flags of a text, in catalog order."""
    found = [F.when(F.rlike(text, F.lit("(?iU)" + "|".join(f"(?:{p})" for p in patterns))), F.lit(flag)) for flag, patterns, _, _ in catalog]
    return F.array_compact(F.array(*found))


def _lookup(pairs: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def risk(flags: Column, catalog: Catalog, digits: int | None = 4) -> Column:
    """Noisy-OR: 1 - product of (1 - weight); an unknown flag weighs DEFAULT_WEIGHT."""
    weights = _lookup({flag: w for flag, _, w, _ in catalog})
    p = 1 - F.aggregate(flags, F.lit(1.0), lambda p, f: p * (1 - F.coalesce(F.try_element_at(weights, f), F.lit(DEFAULT_WEIGHT))))
    return p if digits is None else F.round(p, digits)


def explain(flags: Column, catalog: Catalog) -> Column:
    """Texts for flags; an unknown flag explains itself."""
    texts = _lookup({flag: e for flag, _, _, e in catalog})
    return F.transform(flags, lambda f: F.coalesce(F.try_element_at(texts, f), f))
