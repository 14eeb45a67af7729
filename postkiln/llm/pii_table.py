"""The small labelled table that the tagger of personal information is trained from.

Lines are drawn from carrier sentences with marked slots; the slots are filled from invented names, streets and number patterns.
Everything outside a slot is labelled as ordinary text, so the carriers with numbers, projects and times that look like personal
information teach what to leave alone. The draw is seeded: the table is the same everywhere.
"""

from __future__ import annotations

import random

KINDS = ("email", "phone", "id_number", "address", "name")

# Invented persons (given names and surnames of four languages, two scripts).
GIVEN = "Anneke Tobin Marisol Quentin Odalys Perrin Sunniva Halvard Ludmila Yaroslav Evdokia Timofei Anfisa Gerwin Ottilie Wilfried Roswitha Hartmut Zuleide Joaquim Iracema Valdemar Jussara Catarina Leocádia Günther Käthe André Лидия Тимофей Анфиса Ярослав Евдокия Макар Василиса Прохор Устинья Федот Maeve Callum Bronwen Idris Elspeth Rupert Saskia Magnus".split()
SURNAMES = "Thornbeck Ashgrove Winterbourne Hallowfield Crabtree O'Dwyer McAllen Fitz-Rowan Pemberly Blackmere Stonehurst Eichendorff Lindenbach Rosskamp Feldhüter Grünewald Weißkopf Birnstiel Carvalhinho Oliveirense Figueiral Nogueirinha Pitangueira Semenchuk Ryabinko Zhuravlyov Polevichenko Семенчук Рябинко Журавлёв Полевиченко Сосновых Берёзкин Кленовый Лесничий Травкина Озерных Dorsten".split()
_PARTS = ("", "", "", "", "von ", "da ", "dos ", "de ", "van ")
# Invented projects, streets and towns, which look like names.
PROJECTS = "Hartwell Bramblewick Ospreyne Cindermoor Larkholme Vantage-7 Solstice-X Quillmere Redfern-2 Mistral Cobaltine Duskwater Fernhollow Greystead Ironvale Juniperra Nettlecroft Oakenshaw Pinebarrow Tidemark".split()
_ROADS = ("Lane", "Street", "Road", "Crescent", "Avenue", "Court", "Drive", "Terrace", "Square", "Way")
_PLACES = "Ashby Tallow Larch Miller Fenwick Harbour Stonebridge Willow Old Mill New Forge Copper Birch Hill Heron Quay".split()
_TOWNS = "Marlford Ostbury Kestrelton Wexmere Dunholm Bridgeham Fairhaven Millport Ravensby Stonehaven".split()
_RU_STREETS = ("Рябиновая", "Новолесная", "Садового Кольца", "Верхнеполевая", "Озёрная-Старая", "Тихого Луга", "Полевая")
_RU_TOWNS = ("Новолуговск", "Озерград", "Верхнереченск", "Старополье")
_PT_STREETS = ("das Palmeiras", "do Engenho Novo", "dos Ipês", "da Fonte Clara", "Boa Vista", "Serra Alta", "do Moinho")
_PT_TOWNS = ("Vila Clara", "Campo Verde", "Porto Sereno", "Monte Manso", "Serra Bela")
_DE_STREETS = ("Birkenwaldstraße", "Amselgrundweg", "Mühlbachgasse", "Lindenallee", "Am Rosenhang", "Im Wiesengrund", "Schlehenplatz", "Lerchenfeldstr.")
_DE_TOWNS = ("Birkenrode", "Neulindenstadt", "Mühlhagen", "Amselfurt")
_MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December", "января", "февраля", "марта", "апреля", "июня", "июля", "Oktober", "März", "April", "de maio de", "de julho de")
_ZONES = ("alder.example", "mail.birch.example", "cedar.test", "dogwood.invalid", "elm.example")

# Sentences that carry personal information. {N} name, {G} one name, {E} address of mail, {P} phone, {I} identity number, {A} street address.
CARRIERS = """
You can reach {N} at {P}.
{N} asked me to pass it on.
{G} asked me to pass it on.
{G} asked for it.
Call {N} on {P} or write to {E}.
My new desk line is {P}, the old {E} is gone.
My number changed to {P}.
Please send the signed copy to {E}.
cc {E} and tell Mr {S}.
cc {E} and tell Ms {S}.
For the badge we need {I} from {N}.
Form filed under {I}.
The courier should go to {A}.
{N} moved; the new place is {A}, mobile {P}.
{N} moved; the new place is {A}.
Свяжитесь с коллегой: {N}, тел. {P}.
{G} просит передать документы.
{N} просит передать документы.
Для пропуска нужны данные: {N}, {I}.
Заявка оформлена на {I}.
Курьера отправьте по адресу {A}.
{N} теперь сидит здесь: {A}.
{N} теперь сидит здесь: {A}, моб. {P}.
Новый номер {P}, почта {E}.
Подписанный экземпляр направьте на {E}.
Fale com {N} pelo {P}.
{G} pediu para avisar.
{N} pediu para avisar.
Para o crachá falta o {I} de {N}.
Cadastro feito com {I}.
O entregador deve ir para {A}.
{N} mudou; o novo endereço é {A}, celular {P}.
{N} mudou de sala: {A}.
Ramal novo {P}, e-mail {E}.
Mande a cópia assinada para {E}.
{G} hat darum gebeten.
{N} hat darum gebeten.
Sie erreichen {N} unter {P}.
Für den Ausweis brauchen wir {I} von {N}.
Abgelegt unter {I}.
Der Kurier soll zu {A} fahren.
{N} ist umgezogen: {A}, mobil {P}.
Neue Durchwahl {P}, Mail {E}.
Rückfragen bitte an {N}, Tel. {P}.
Neue Nummer {P}, Adresse {E}.
Bitte die unterschriebene Fassung an {E} senden.
From: {N} <{E}>
*From:* {N} <{E}>
От: {N} <{E}>
*От:* {N} <{E}>
Von: {N} <{E}>
De: {N} <{E}>
*De:* {N} <{E}>
To: {E}
*Кому:* {E}
An: {E}
Para: {E}
On {D} {N} wrote:
On {D}, {N} <{E}> wrote:
{D}, {N}:
{D}, {N} <{E}>:
{D} пользователь {N} <{E}> написал(а):
Am {D} schrieb {N}:
Am {D} schrieb {N} <{E}>:
Em {D}, {N} escreveu:
Em {D}, {N} <{E}> escreveu:
{N}
{N}
{N}
{G}
{G}
{N} | Planner
{N} | Project Lead | {E}
{N} | ведущий инженер | {P}
{N} | Analista | {E} | {P}
Tel. {P}
T: {P}
m. {P}
☎ {P}
тел. {P}
{P}
{E}
{E}
{A}
{A}
Re: Minutes, {J} week 5 / {P}
Fwd: Update on {J} / {N}
{P}: Re: the {J} plan
Новости {J} / план работ ({N})
{I} (Итоги встречи, {J}, неделя 7)
{A} ({J}: the review)
{N} ({J}: the review)
Re: {E}: the draft
{N}: Stand {J} / die Liste
{I}: RE: Question about the list
RE: {I}: Action needed: the list ({J})
Re: {I} / Frage zu {J}
AW: {I}: Stand {J}
"""
# Sentences without personal information. {J} project, {T} ticket, {#} a number, {L} a long number, {V} version, {H} hash, {C} clock, {D} date.
ORDINARY = """
Order no. {L} is packed.
Total {#} {L} {#} units, batch {#}/{#}.
Part ref {#}-{#}-{L} is out of stock.
Part ref -{L} is out of stock.
Run id {#}-{#}-{#} finished in {#} min.
Hash {H} matches.
Node {#}.{#}.{#}.{#} rebooted.
Node 10.{#}.{#}.{#} is back.
Alert {J}-{L}
value={#} limit={#} window={#}m
{C} INFO {J} step={#} dur={#}ms
{C} WARN {J} step={#} dur={#}ms
For {J} we compared the plan with the list in line with note {T}.
On {J}, the audit group closed the review, and the night shift archived the draft.
{J}: the plan and the list are still open in build {V}.
Could you confirm whether the search team merged the draft once ticket {T} is closed?
I would rather see the plan settled to keep the cost under {#} credits, since procurement is waiting.
Please note that facilities reopened the list using the figures from week {#}.
Because the totals differ by {#} units, the mobile team is comparing the draft for {J}.
Для {J} мы сравнили план и таблицу по заметке {T}.
По {J} группа выпуска уже проверяет список, а учебный центр вернул план.
{J}: план и список нужно закрыть в сборке {V}.
Обратите внимание: складская служба убрала в архив список хотя {#} строк ещё открыты.
Подскажите, команда поиска просит упростить план до {#} числа?
Лучше решить про план потому что итоги расходятся на {#} единиц.
Für {J} haben wir den Plan und die Liste verglichen, gemäß Notiz {T}.
Bei {J} gilt: die Netztechnik führt die Liste zusammen, und der Einkauf prüft den Plan.
Bitte beachten: das Datenteam zeigt die Regeln in Fassung {V}.
Können Sie bestätigen: die Lagerstelle verschiebt den Plan obwohl {#} Zeilen offen sind?
Em {J}, a equipe de cobrança juntou a tabela, e o time de dados validou o plano.
Para {J} comparamos a planilha e o plano conforme a nota {T}.
Atenção: o laboratório de qualidade adiou a lista para ficar abaixo de {#} créditos.
Pode confirmar se a mesa jurídica reescreveu a lista na versão {V}?
A área de compras vai apresentar a lista na janela de manutenção.
O suporte de segundo nível validou o plano antes da reunião geral.
A operação de campo ainda revisa a tabela como solução provisória.
A engenharia de redes entregou o plano após o segundo ensaio.
O time de busca reescreveu a lista para {J}.
A folha de pagamento acompanha o plano em {J}.
Die Nachtschicht öffnet erneut den Plan für {J} vor der Runde.
Der Einkauf vergleicht gerade die Liste mit den Zahlen aus Woche {#}.
Unser Freigabeteam bestätigt den Plan im Wartungsfenster.
The pricing group has postponed the review for {J} despite the late change in {T}.
Second-line support rolled back the plan once ticket {T} is closed.
As agreed on the {#}th, vendor management signed off on the list.
Группа тарифов перенесла на неделю план до общего созвона.
Бюро переводов оценивает список с запасом в {#} процентов.
Не трогая старый поток ночная смена описала итоги в {J}.
Quarterly plan and Holiday list stay as they are.
Hi all,
Hello,
Team,
Dear colleagues,
Good morning,
Коллеги, добрый день!
Всем привет,
Здравствуйте!
Guten Tag,
Hallo zusammen,
Liebe Kolleginnen und Kollegen,
Moin,
Prezados,
Olá a todos,
Bom dia,
Best regards,
Kind regards,
Cheers,
С уважением,
Всего доброго,
Mit freundlichen Grüßen
Viele Grüße,
Atenciosamente,
Abraços,
Stock Planner
Shift Lead
Account Analyst
Release Coordinator
координатор поставок
ведущий специалист
Sachbearbeitung
Projektbüro
Coordenação de estoque
Analista
Sent from my handset
Отправлено с телефона
Von unterwegs gesendet
Enviado do meu celular
Sent: {D}
*Sent:* {D}
*Отправлено:* {D}
Gesendet: {D}
Enviada em: {D}
Subject: Re: Update on {J} / the weekly list
Тема: Новости {J} / план
*Assunto:* RES: {J}: a tabela
Betreff: AW: Stand {J} / der Plan
Re[2]: Minutes, {J} week {#}
Action needed: the weekly list ({J})
[WARN] {J} threshold {#} on node {#}
[OK] {J} threshold {#} on node {#}
{T} the courier table
AW: Frage zu {T}
Routing of the pallets:
From: north depot
To: south depot
От: склада А
К: складу Б
The rule fires when latency is
{#} ms for two nodes.
Mark the folder confidential and give it our best regards only in the final letter.
He wrote: keep it short, and the desk agreed.
-----Original Message-----
-------- Исходное сообщение --------
-----Ursprüngliche Nachricht-----
-----Mensagem original-----
The original message counter shows {#}.
Confidential - for internal planning. Figures are unaudited and bind nobody.
[EXTERN] Bitte Anhänge prüfen.
ВНИМАНИЕ: внешний отправитель, проверяйте ссылки и вложения.
Ask release-desk in the channel.
Handle @depot-north is not a mailbox.
The mail gateway accepts user@host lists.
"""


class _Filler:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def digits(self, pattern: str) -> str:
        return "".join(self.r.choice("0123456789") if c == "d" else c for c in pattern)

    def given(self) -> str:
        return self.r.choice(GIVEN)

    def surname(self) -> str:
        return self.r.choice(SURNAMES)

    def name(self) -> str:
        a, b = self.given(), self.r.choice(_PARTS) + self.surname()
        return self.r.choice([f"{a} {b}"] * 5 + [f"{b} {a}", f"{a[0]}. {b}", f"{a} {b}-{self.surname()}"])

    def email(self) -> str:
        r = self.r
        a, b = r.choice("anna tobin marisol perrin odalys timofei gerwin".split()), r.choice("thornbeck ashgrove rosskamp semenchuk nogueirinha".split())
        local = r.choice([f"{a}.{b}", f"{a[0]}{b}", f"{b}_{a}", f"{a}-{b[:5]}", f"{b}_{a}{r.randrange(9999)}"])
        host = r.choice(_ZONES)
        return r.choice([f"{local}@{host}"] * 7 + [f"<{local}@{host}>", f"mailto:{local}@{host}", f"{local} (at) {host}", f"{local} at {host.replace('.', ' dot ')}", f"{local}[at]{host}", f"{local} [at] {host.replace('.', ' [dot] ')}", f"{local.upper()}@{host.upper()}", f"{local} @ {host}"])

    def phone(self) -> str:
        return self.digits(self.r.choice(["+1 (ddd) 555-01dd", "ddd-555-01dd", "ddd.555.01dd", "(ddd) 555 01dd ext. d", "+1ddd55501dd", "(ddd) 555-01dd", "+1 ddd 555 01dd", "+7 (000) ddd-dd-dd", "8-000-ddd-dd-dd", "8 000 ddd dd dd", "+7000ddddddd", "8 (000) ddd-dd-dd", "+55 (00) 9ddd-dddd", "(00) 9ddd-dddd", "00 9ddd.dddd", "+55 00 9dddd-dddd", "+55009dddddddd", "(030) 23125-ddd", "030/23125 ddd", "030 23125-ddd", "+49 30 23125 ddd", "+49 (0)30 23125-ddd", "+493023125ddd", "0049 30 23125ddd", "0049 30 ddddddd", "001 ddd 555 01dd", "+44 20 7946 0ddd", "020 7946 0ddd", "+91 ddddd ddddd"]))

    def identity(self) -> tuple[str, str]:
        word, number = self.r.choice([("SSN ", "ddd-dd-dddd"), ("SSN ", "000-dd-dddd"), ("social security number ", "000dddddd"), ("social security number ", "ddddddddd"), ("National Insurance ", "QQ dd dd dd C"), ("National Insurance no. ", "QQddddddC"), ("passport no. ", "X00dddddd"), ("passport ", "Xdddddddd"), ("ИНН ", "00dddddddddd"), ("ИНН ", "dddddddddd"), ("СНИЛС ", "000-ddd-ddd dd"), ("паспорт ", "00 dd dddddd"), ("паспорт серия ", "00dd № dddddd"), ("CPF ", "000dddddddd"), ("CPF ", "000.ddd.ddd-dd"), ("RG ", "00.ddd.ddd-d"), ("Steuer-ID ", "00 ddd ddd ddd"), ("Steuer-ID ", "00ddddddddd"), ("Sozialversicherungsnummer ", "00 dddddd Q ddd"), ("Ausweisnummer ", "L00XddddK"), ("Ausweisnummer ", "LddXddddK"), ("Personalausweis ", "LddXddddK")])
        return word, self.digits(number)

    def address(self) -> str:
        r = self.r
        n, m = r.randrange(1, 200), r.randrange(1, 60)
        road = f"{r.choice(_PLACES)}{r.choice(['', ' ' + r.choice(_PLACES)])} {r.choice(_ROADS)}"
        ru, pt, de = r.choice(_RU_STREETS), r.choice(_PT_STREETS), r.choice(_DE_STREETS)
        town, ru_town, pt_town, de_town = r.choice(_TOWNS), r.choice(_RU_TOWNS), r.choice(_PT_TOWNS), r.choice(_DE_TOWNS)
        code = self.digits("000dd")
        return r.choice([
            f"{n} {road}, Flat {m}, {town}", f"No. {n} {road}, floor {m}, {town}", f"{n} {road} Unit {m}, {town} Town", f"{n} {road}, Apt {m}, {town} ZZ", f"{n} {road}, {town}",
            f"ул. {ru}, д. {n}, кв. {m}", f"улица {ru}, дом {n}, офис {m}", f"пер. {ru}, {n}, стр. {m}", f"г. {ru_town}, {ru} ул., {n}-{m}", f"пр-т {ru}, д. {n}",
            f"Rua {pt}, {n}, apto {m}, {pt_town}", f"R. {pt} nº {n} - casa {m}, {pt_town}", f"Av. {pt}, {n}, sala {m}, {pt_town}", f"Ladeira {pt} nº {n} - casa {m}, {pt_town}", f"Travessa {pt}, {n}, {pt_town}", f"Alameda {pt}, {n}, sala {m}, {pt_town}",
            f"{de} {n}, {code} {de_town}", f"{de} {n}, D-{code} {de_town}", f"{de} {n}a, {code} {de_town}", f"{de} {n}",
        ])

    def date(self) -> str:
        r = self.r
        d, h, m, month = r.randrange(1, 29), r.randrange(24), r.randrange(60), r.choice(_MONTHS)
        return r.choice([f"{d} {month} 2024, {h:02}:{m:02}", f"{month} {d}, 2024 at {h % 12 + 1}:{m:02} {r.choice(('AM', 'PM'))}", f"{d} {month[:3]} 2024 {h:02}:{m:02}", f"{d} {month} 2024 г. в {h:02}:{m:02}", f"{d}. {month} 2024 um {h:02}:{m:02}"])


def _weight(line: str) -> int:
    """Draws of a line in each round: more for slots with many patterns, and for names that stand alone."""
    return 4 if "{I}" in line else 3 if line in ("{N}", "{G}") or line.startswith("{G} ") else 2 if "{P}" in line or "{A}" in line or "{D}" in line else 1


def labelled_table(rounds: int = 8, seed: int = 11) -> list[list[tuple[str, str]]]:
    """Lines as lists of (text, kind), kind '' for ordinary text. ``rounds`` draws of every carrier bound the table."""
    fill = _Filler(seed)
    r = fill.r
    plain = {
        "J": lambda: r.choice(PROJECTS), "T": lambda: r.choice(("ABC", "DEP", "QA", "NET", "LOG", "FIN", "OPS", "REQ")) + fill.digits("-ddddd"), "#": lambda: str(r.randrange(1, r.choice((60, 300, 9000)))),
        "L": lambda: fill.digits(r.choice(("dddddddddd", "ddddddd", "dddddd"))), "V": lambda: fill.digits("d.dd.dd"), "H": lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice((16, 40)))),
        "C": lambda: fill.digits("12:d3:2d"), "D": fill.date,
    }
    out = []
    for _ in range(rounds):
        for line in [x for x in (CARRIERS + ORDINARY).strip().split("\n") for _ in range(_weight(x))]:
            parts: list[tuple[str, str]] = []
            rest = line
            while rest:
                before, brace, after = rest.partition("{")
                if before:
                    parts.append((before, ""))
                if not brace:
                    break
                slot, _, rest = after.partition("}")
                if slot == "N":
                    parts.append((fill.name(), "name"))
                elif slot == "G":
                    parts.append((fill.given(), "name"))
                elif slot == "S":
                    parts.append((fill.surname(), "name"))
                elif slot == "E":
                    parts.append((fill.email(), "email"))
                elif slot == "P":
                    parts.append((fill.phone(), "phone"))
                elif slot == "A":
                    parts.append((fill.address(), "address"))
                elif slot == "I":
                    word, number = fill.identity()
                    parts += [(word, ""), (number, "id_number")]
                else:
                    parts.append((plain[slot](), ""))
            if "{G}" in line or "{N}" in line or "{I}" in line or "{P}" in line:
                # the same sentence inside a paragraph
                if len(line) > 12 and line.endswith((".", "?")) and r.random() < 0.5:
                    sentence = r.choice([x for x in ORDINARY.strip().split("\n") if x.endswith((".", "?")) and "{H}" not in x and "{C}" not in x])
                    for slot, draw in plain.items():
                        sentence = sentence.replace("{" + slot + "}", draw())
                    parts = [(sentence + " ", ""), *parts] if r.random() < 0.7 else [*parts, (" " + sentence, "")]
            if r.random() < 0.15:
                parts.insert(0, (r.choice(("> ", "| ", ">> ", "» ")), ""))
            out.append(parts)
    return out
