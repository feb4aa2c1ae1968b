"""How likely a word is in a group of languages: letter pairs counted in short public texts.

The texts are articles of the Universal Declaration of Human Rights and everyday phrases; they teach
which letters stand beside which, and are no word list.
"""

from __future__ import annotations

import math
import re
from functools import cache, lru_cache

# Sample texts by group of languages.
TEXTS = {
    "western": """
All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood. Please find the invoice for your order attached to this message.
Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geist der Brüderlichkeit begegnen. Mit freundlichen Grüßen, die Prüfung der Gebühr ist größtenteils gelöscht, ungültige Empfänger, Bestätigung für die Überweisung, Straße, Mädchen, Öl, Äpfel.
Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité. Réponse à la créance reçue, où l'élève préféré paraît naïf, ça ira même à Noël, déjà très tôt, bannière, échéance, cœur, œuvre, forêt, île, août, hôtel, ÉCOLE, ÉTÉ, À PARIS, DÉJÀ.
Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros. Señal añadida mañana según el número, acción legítima, también envíos, pingüino, más rápido, ¿qué tal?, aquí, será, ÁREA, ÚLTIMO, ÍNDICE, ÓRGANO, AÑO.
Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade. Não são informações, coração, lições, você, avó, três, maçã, ação, último.
Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza. Perché è già così, più città, può, lunedì, virtù.
Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen. België, één, coördinatie.
Alle mennesker er født frie og lige i værdighed og rettigheder. De er udstyret med fornuft og samvittighed, og de bør handle mod hverandre i en broderskabets ånd. På dansk må vi også gå på gaden, før året går, ærø, øl, å.
Alle mennesker er født frie og med samme menneskeverd og menneskerettigheter. De er utstyrt med fornuft og samvittighet og bør handle mot hverandre i brorskapets ånd. Vær så snill, både nå og så.
Alla människor är födda fria och lika i värde och rättigheter. De har utrustats med förnuft och samvete och bör handla gentemot varandra i en anda av gemenskap. Många små räkor på vår ö, Åsa, återställ lösenordet för ditt konto.
Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. Hyvää päivää, älä epäröi, yöllä.
Hver maður er borinn frjáls og jafn öðrum að virðingu og réttindum. Menn eru gæddir vitsmunum og samvisku, og ber þeim að breyta bróðurlega hverjum við annan. Það er þýðing, Ísland, Þór, Ægir, góðan daginn, sími, já, á, ó.
""",
    "central": """
Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. Zażółć gęślą jaźń, dziękuję bardzo, proszę o wiadomość, źródło, książka, żeby, już, też, może, cześć, płatność, wysłać, łódź, święta, będzie, należy.
Všichni lidé se rodí svobodní a sobě rovní co do důstojnosti a práv. Jsou nadáni rozumem a svědomím a mají spolu jednat v duchu bratrství. Příliš žluťoučký kůň úpěl ďábelské ódy. Děkuji, prosím, účet, zpráva, číslo, větší, řízení, ještě, může, platba, příloha, tři.
Všetci ľudia sa rodia slobodní a sebe rovní, čo sa týka ich dôstojnosti a práv. Sú obdarení rozumom a majú navzájom jednať v bratskom duchu. Ďakujem, správa, účet, môže, kôň, vŕba, späť, žiť, ťava, ľahko.
Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek. Köszönöm szépen, kérjük, erősítse meg, főnök, nő, idő, űr, fű, gyűlés, tűz, előző, üdvözlettel.
Sva ljudska bića rađaju se slobodna i jednaka u dostojanstvu i pravima. Ona su obdarena razumom i sviješću i trebaju jedna prema drugima postupati u duhu bratstva. Čestitamo, račun, šaljemo, također, riječ, kuća, noć, više, želim, đak, dođi, možda.
Toate ființele umane se nasc libere și egale în demnitate și în drepturi. Ele sunt înzestrate cu rațiune și conștiință și trebuie să se comporte unele față de altele în spiritul fraternității. Vă mulțumim, această, câte, român, până, țară, dacă, mâine. Fiinţele, şi, ţară, raţiune, conştiinţă, aşa.
Vsi ljudje se rodijo svobodni in imajo enako dostojanstvo in enake pravice. Obdarjeni so z razumom in vestjo in bi morali ravnati drug z drugim kakor bratje. Račun, številka, že, življenje, želja, človek, več.
""",
    "turkish": """
Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler. Teşekkür ederim, lütfen, doğru, değil, için, çalışma, şifre, güncelleme, kargo, sipariş, bağlantı, ışık, yarın, İstanbul, İyi günler, ağaç, başka, öğrenci, şey.
""",
    "cyrillic": """
Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства. Каждый человек имеет право на жизнь, на свободу и на личную неприкосновенность. Срочно: письмо и проверка счёта, отчёт за неделю, новая подпись сервера, отдел доставки, служба поддержки, ваш пароль истекает завтра, пожалуйста, подтвердите получение, спасибо за заказ, привет, съешь же ещё этих мягких французских булок, да выпей чаю. Ольга, Лидия, Тимур, Иван, Мария, Дмитрий, Екатерина, Сергей, Александр, Анна, Петрова, Иванов, Смирнова, Кузнецов, Соколовская, Горский.
Всі люди народжуються вільними і рівними у своїй гідності та правах. Вони наділені розумом і совістю і повинні діяти у відношенні один до одного в дусі братерства. Дякуємо, їжак, є, ще, який, Київ, об'єкт.
Всички хора се раждат свободни и равни по достойнство и права. Те са надарени с разум и съвест и следва да се отнасят помежду си в дух на братство. Благодаря, първи, България, съобщение, още.
Сва људска бића рађају се слободна и једнака у достојанству и правима. Она су обдарена разумом и свешћу и треба једни према другима да поступају у духу братства. Хвала, џеп, њега, ђак, кућа.
""",
    "greek": """
Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση, και οφείλουν να συμπεριφέρονται μεταξύ τους με πνεύμα αδελφοσύνης. Κάθε άτομο έχει δικαίωμα στη ζωή, την ελευθερία και την προσωπική του ασφάλεια. Καλημέρα κόσμε, ευχαριστώ πολύ, παρακαλώ επιβεβαιώστε την πληρωμή, ο λογαριασμός σας, μήνυμα, διεύθυνση, Αθήνα, Γιώργος, Ελένη, Μαρία, Παπαδόπουλος, ψυχή, ΐ, ΰ, ξένος, φως.
""",
    "chinese": """
人人生而自由在尊严和权利上一律平等他们赋有理性和良心并应以兄弟关系的精神相对待 的一是不了在人有我他这个们中来上大为和国地到以说时要就出会可也你对生能而子那得于着下自之年过发后作里用道行所然家种事成方多经么去法学如都同现当没动面起看定天分还进好小部其些主样理心她本前开但因只从想实日军者意无力它与长把机十民第公此已工使情明性知全三又关点正业外将两高间由问很最重并物手应战向头文体政美相见被利什二等产或新己制身果加西斯月话合回特代内信表化老给世位次度门任常先海通教儿原东声提立及比员解水名真论处走义各入几口认条平系气题活尔更别打女变四神总何电数安少报才结反受目太量再感建务做接必场件计管期市直德资命山金指克许统区保至队形社便空决治展马科司五基眼书非则听白却界达光放强即像难且权思王象完设式色路记南品住告类求据程北边死张该交规万取拉格望觉术领共确传师观清今切院让识候带导争运您好谢谢请收账单密码邮件发送服务器
""",
    "traditional": """
人人生而自由在尊嚴和權利上一律平等他們賦有理性和良心並應以兄弟關係的精神相對待 的一是不了在人有我他這個們中來上大為和國地到以說時要就出會可也你對生能而子那得於著下自之年過發後作裡用道行所然家種事成方多經麼去法學如都同現當沒動面起看定天分還進好小部其些主樣理心她本前開但因只從想實日者意無力它與長把機十民第公此已工使情明性知全三又關點正業外將兩高間由問很最重並物手應向頭文體政美相見被利什二等產或新己制身果加西月話合回特代內信表化老給世位次度門任常先海通教兒原東聲提立及比員解水名真論處走義各入幾口認條平系氣題活更別打女變四神總何電數安少報才結反受目太量再感建務做接必場件計管期市直德資命山金指統區保至形社便空決治展馬科司五基眼書非則聽白卻界達光放強即像難且權思王完設式色路記南品住告類求據程北邊死張該交規萬取拉格望覺術領共確傳師觀清今切院讓識候帶導爭運您謝請收帳單密碼郵件發送伺服器
""",
    "japanese": """
すべての人間は生まれながらにして自由でありかつ尊厳と権利とについて平等である人間は理性と良心とを授けられており互いに同胞の精神をもって行動しなければならない こんにちはありがとうございますよろしくお願いします請求書を添付しましたのでご確認くださいお世話になっております株式会社東京日本電話番号メール送信件名返信転送エラーサーバーパスワードアカウント更新ログインサービスデータシステムテストフォーム キャンペーンセキュリティ 今日明日昨日時間本年月日曜会社員名前住所大丈夫これはそれからどこいつなぜ何誰人々私達彼女新しい古い大きい小さい高い安い
""",
    "korean": """
모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다 인간은 천부적으로 이성과 양심을 부여받았으며 서로 형제애의 정신으로 행동하여야 한다 안녕하세요 감사합니다 주문하신 상품의 배송이 시작되었습니다 비밀번호를 확인해 주세요 메일 계정 서비스 고객 센터 한국 서울 대한민국 회사 이름 전화 주소 오늘 내일 어제 우리는 그것이 있는 하는 되는 없는 수 것 등 및 대로 에서 까지 부터 으로
""",
}
_WORD = re.compile(r"[^\W\d_]+")
#: The log chance of a sign inside a word, where letters should be, and of a word whose case no one writes.
SIGN, CASE = -9.0, -10.0


@cache
def pairs(group: str) -> tuple[dict[str, float], dict[str, float], dict[str, float]]:
    """(log chances of letter pairs seen, of letters, of a new neighbour of a letter) of a group of languages, in lower case; a blank ends a word.

    Smoothed after Witten and Bell: a letter has new neighbours the more often, the more different ones it had.
    """
    two: dict[str, int] = {}
    for w in _WORD.findall(TEXTS[group].lower()):
        marked = f" {w} "
        for a, b in zip(marked, marked[1:], strict=False):
            two[a + b] = two.get(a + b, 0) + 1
    one: dict[str, int] = {}
    before: dict[str, int] = {}
    kinds: dict[str, int] = {}
    for (a, b), n in two.items():
        one[b] = one.get(b, 0) + n
        before[a] = before.get(a, 0) + n
        kinds[a] = kinds.get(a, 0) + 1
    total = sum(one.values()) + 1
    chance = {c: n / total for c, n in one.items()}
    known = {ab: math.log((n + kinds[ab[0]] * chance[ab[1]]) / (before[ab[0]] + kinds[ab[0]])) for ab, n in two.items()}
    fresh = {a: math.log(kinds[a] / (n + kinds[a])) for a, n in before.items()}
    return known, {c: math.log(p) for c, p in chance.items()} | {"": math.log(0.2 / total)}, fresh


def regular(word: str) -> bool:
    """Whether a word is written as words are: all small, all capital, or with a capital first."""
    return word.islower() or word.isupper() or word[1:].islower() or len(word) == 1


@lru_cache(maxsize=65536)
def score(group: str, word: str) -> float:
    """The log chance of a word; what isn't a letter costs as a sign, and odd case costs once."""
    known, single, fresh = pairs(group)
    marked, total = f" {word.lower()} ", 0.0
    for a, b in zip(marked, marked[1:], strict=False):
        if a + b in known:
            total += known[a + b]
        elif b == " " or b.isalpha():
            total += single.get(b, single[""]) + fresh.get(a, 0.0)
        else:
            total += SIGN
    return total if regular(word) else total + CASE


@cache
def signs(group: str) -> tuple[dict[str, float], float]:
    """(log chances of single signs, of one never seen) of a script written without blanks."""
    one: dict[str, int] = {}
    for c in "".join(TEXTS[group].split()):
        one[c] = one.get(c, 0) + 1
    total = sum(one.values())
    return {c: math.log(n / (total + 500)) for c, n in one.items()}, math.log(500 / (total + 500) / 4000)
