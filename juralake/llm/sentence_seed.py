"""Fixed values for training the sentence model: annotated everyday sentences and word lists, written for this package.

No phrase of them is taken from any table; a test holds that. In SEED a bar ends a unit. {n} stands for a name, {d} for a number,
{l} for a small one, {m} for an amount, {t} for a date; training fills them at random and joins units of one language by
varying white space, so that what follows a mark varies too.
"""

from __future__ import annotations

#: Abbreviations before a name, which end no unit.
TITLES = "Dr Mr Mrs Ms St Messrs Prof Hon Rev Gen Col Sgt Sr Sra Srta Dra Don D.ª M MM Mme Mlle Me Hr Fr Frl Dipl Ing Mag Проф проф акад доц г-н г-жа κ κα Δρ δρ د أ डॉ श्री श्रीमती प्रो Lic Exmo Exma Ilmo Eng Dott".split()
#: Abbreviations before a number, a letter or another reference, which end no unit.
COUNTED = "No Nos no nos Art Arts art arts Sec Secs sec para paras Para pp p pg pgs vol Vol vols fig Fig ann Ann cl Cl ch Ch app App reg Reg r núm Núm núms pág Pág págs apdo Apdo inc lit let al n Nr nr Abs S Bd Az Rn Ziff Kap Anm Tz Anl Bl ст п пп ч т с стр гл рис № разд άρθ Άρθ παρ αρ Αρ σελ τ κεφ ص رقم م ج सं पृ अनु धारा proc Proc liv cap Cap fl fls".split()
#: Abbreviations within a sentence that end none.
INNER = "c e.g i.e cf Cf v vs c viz ca approx per incl excl vgl Vgl bzw z d u s o sog ggf evtl insb inkl exkl gem ex ej por p.ex p.ej т см См ср напр тыс млн млрд им π.χ δηλ βλ Βλ πρβλ λ.χ i.V m.E z.B d.h u.a o.g resp Ver ver".split()
#: Abbreviations that may stand at the end of a sentence: firms, places, times and the like.
OPEN = "Corp Inc Ltd Co Bros LLC PLC plc etc Etc seq a.m p.m S.A S.L S.R.L S.p.A Ltda Cia Cía Lda S.A.S SARL GmbH AG KG e.V u.a usw ff f h H hrs min Α.Ε Ε.Π.Ε О.О.О г гг др пр κ.λπ κτλ U.K U.S U.S.A E.U U.N D.C Jr Sen Esq Dept Uhr".split()
#: What precedes the number of a heading.
PARTS = "Part Section Chapter Title Book Teil Abschnitt Kapitel Partie Titre Chapitre Parte Sección Capítulo Título Часть Раздел Глава Μέρος Κεφάλαιο".split()
MONTHS = "Januar Februar März April Mai Juni Juli August September Oktober November Dezember Jänner".split()
#: Words that carry a sentence on after a closing quote, in scripts without case.
CARRY = ("并", "並", "且", "但", "而", "后", "と", "とは", "って", "और", "कि", "तथा", "जो", "و", "ثم", "ف")

SEED = {
    "en": """{n} planted {d}/{d} roses behind the mill.|The kettle of {n} boils at {m} degrees.|The ferry left on {t}.|Will bus {d}.{d} wait for {n} past {t}?|Who fed {n}, and how often, in week {d}?!|{d} geese flew over {n}!
“{n} ate {m} plums.”|“The soup went cold. Nobody dined on {t},” the cook of {n} told a guest.|The baker wrote: “Is {n} awake? Maybe.” and shut oven no. {d}.|Dr. {n} and Ms. {n} sang at {d}.{d} p.m. on {t}.|(See map {d} in the {n} atlas, drawn {t}.)|By Art. {d} and Sec. {d} of the {n} Almanac, the moon wanes.
Snacks, e.g. nuts, i.e. {m} grams, go to {n} ... unless {n} naps.|{n} waited for {n} until {t}…|The piano made on {t} was tuned by {n} Corp.|{n} read Nos. {d}, {d} and {d}.{d} (as reprinted on {t}; cf. fig. {d}), not St. {n} Corp. leaflets.|The choir sings, per J. {n}, a song in bar {d} of {n}.
{n} Ltd. v. {n} Inc., No. {d}, made the news (see vol. {d}, p. {d}).|The U.K. team of {n} ran {m} miles under para. {d} et seq. of its plan.|(a) The gardener {n} waves.|{l}. The painter {n} rests.|{l}.{l}.{l}. The tailor {n} hums.|{l}.{l} The nurse {n} sleeps.|{l}.{l} {n} yawns.|They grew up in the U.K.|Her workshop is {n} Ltd.|The film starts at {d} p.m.|He packs socks, hats, etc.|Part {l}. Meadows|The shelf holds: (a) jam; (b) figs; and (c) tin {d}/{d} of {n}.|{n} bakes; {n} sweeps, though rain is near.|The wind rose to {m} knots, and {n} hid in hut {d}.{d}.|A parrot of {n} knows the words ‘night’ and ‘day’.|Rivers of {n} froze on {t} — {n} skated anyway.""",
    "fr": """Le chat de {n} dort sous la neige de {n}.|La tante {n} a cuit un gâteau pesant {m} grammes.|Le train {d}.{d} attend-il {n} après le {t} ?|« {n} mange {m} prunes. »|« La soupe était froide. Personne n'est venu le {t} », a crié le cuisinier de {n}.|M. {n} et Mme {n} dansent le {t} à {d} h.
Le match {n} c. {n}, n° {d}, est raconté au vol. {d}, p. {d}.|Selon l'art. {d}, al. {d}, de l'almanach {n}, la lune monte.|Les goûters, cf. recette {d}, sont offerts par {n} S.A. et ses voisins, etc., avec {m} cerises.|{n} a guetté {n} jusqu'au {t}…|(Voir la carte {d} du guide {n}.)|Le piano vient de {n} S.A.|{l}. Le peintre {n} rit.|{l}.{l}.{l}. Le tailleur {n} chante.|{l}.{l} La nageuse {n} plonge.|(b) Le jardinier {n} salue.|{d} oies survolent {n} !|Le vent tombe, et {n} range la cabane {d}/{d}.|Partie {l}. Prairies|Les fleurs d'{n} s'ouvrent ; {n} les arrose.""",
    "de": """Der Bäcker {n} singt im Garten von {n}.|Die Katze {n} jagt Mäuse vor dem {l}. Juni {d}.|Dr. {n} und Hr. {n} kochten am {l}. Mai um {d}.{d} Uhr Suppe Nr. {d}.|Nach § {d} Abs. {d} S. {d} der Fibel {n} wächst der Kürbis um {m} v. H.|„{n} isst {m} Pflaumen.“|„Die Suppe war kalt. Niemand kam am {t}“, rief die Köchin von {n}.
Vorräte, z. B. Nüsse, d. h. {m} Gramm, holt {n} bzw. die {n} GmbH.|Das Spiel {n} ./. {n}, Az. {d}/{d}, wird in Bd. {d}, S. {d} f. erzählt.|Die {n} AG u. a. malten am {l}. {l}. 2011 Bilder von {n}.|Im Wald steht vgl. Karte {d} die {n} & Co. KG neben {n} usw. nach Blatt {d}.|(Siehe Karte {d} im Atlas {n}, Rn. {d}.)|{l}. Abschnitt Wiesen|{d} Gänse flogen über {n}!|{l}. Der Maler {n} ruht.|{l}.{l} Die Ärztin {n} schläft.|{l}.{l}.{l}. Der Schneider {n} summt.|Wartet Bus {d} auf die {n} GmbH?|Der Film beginnt um {d} Uhr.|Er packt Hüte, Socken usw.|{n} wartete bis {t}…|Der Teig schrumpft um {m} v. H.|Das Fest begann am {l}. Oktober {d}, und {n} tanzte.|(c) Die Gärtnerin {n} winkt.|Am {t} fror der Fluss {n}; die Enten von {n} liefen.|Die Uhr von {n} steht seit dem {d}. August {d}.|Kapitel {l}. Wälder""",
    "es": """La abuela {n} riega los tomates de {n}.|El Sr. {n} y la Sra. {n} bailan el {t} a las {d}.{d} h.|El partido {n} c. {n}, núm. {d}, se narra en el vol. {d}, pág. {d}.|Según el art. {d}, apdo. {d}, del almanaque {n}, la luna crece un {m} %.|Las meriendas, p. ej. nueces, las trae {n}, S.L. con {m} cerezas.|El piano viene de {n}, S.A.
«{n} come {m} ciruelas.»|«La sopa estaba fría. Nadie vino el {t}», gritó el cocinero de {n}.|¿Espera el tren {d}.{d} a {n} tras el {t}?|¡{d} gansos volaron sobre {n}!|(Véase el mapa {d} de la guía {n}.)|{l}. El pintor {n} ríe.|{l}.{l} La enfermera {n} duerme.|{l}.{l}.{l}. El sastre {n} canta.|(c) El jardinero {n} saluda.|{n} esperó hasta el {t}…|El viento cae; {n} ordena la cabaña {d}/{d}, aunque llueve.|Capítulo {l}. Praderas""",
    "pt": """A avó {n} rega os tomates de {n}.|O Sr. {n} e a Sra. {n} dançam em {t} às {d}.{d} h.|O jogo {n} c. {n}, proc. {d}, é contado no vol. {d}, p. {d}.|Pelo art. {d}, n.º {d}, do almanaque {n}, a lua cresce {m} %.|Os lanches, p. ex. nozes, são trazidos por {n} Ltda. com {m} cerejas.|“{n} come {m} ameixas.”|“A sopa estava fria. Ninguém veio em {t}”, gritou o cozinheiro de {n}.
O comboio {d}.{d} espera por {n} depois de {t}?|{d} gansos voaram sobre {n}!|(Ver o mapa {d} do guia {n}.)|{l}.{l}.{l}. O alfaiate {n} canta.|{l}.{l} A enfermeira {n} dorme.|{l}. O pintor {n} ri.|Segundo a pág. {d}.º e o art. {d}.º, n.º {d}, a sopa de {n} ferve.|O piano veio da {n} Ltda.|(d) O jardineiro {n} acena.|{n} esperou até {t}…|«{n} come {m} figos.»|O vento cai; {n} arruma a cabana {d}/{d}, embora chova.|Título {l}. Prados""",
    "ru": """Бабушка {n} поливает огурцы у дома {n}.|Проф. {n} и г-жа {n} пели песню № {d} в {d} г. у реки.|По ст. {d} и п. {d} альманаха {n} луна растёт на {m} пальца.|Гостинцы, т. е. {m} слив, несёт {n}, см. т. {d}, с. {d} книги.|«{n} съел {m} слив».|«Суп остыл. Никто не пришёл {t}», — крикнул повар {n}.|(См. карту {d} в атласе {n}, с. {d}.)
Ждёт ли автобус {d} друга {n} после {t}?|Над {n} пролетели {d} гусей!|{l}. Художник {n} смеётся.|{l}.{l} Медсестра {n} спит.|{l}.{l}.{l}. Портной {n} поёт.|(e) Садовник {n} машет.|Песня записана в {d} г.|{n} ждал до {t}…|В саду росли груши, вишни и др.|Ветер стих; {n} убрал лодку {d}/{d}, хотя шёл дождь.|Глава {l}. Луга|На празднике, напр. зимой, {n} ел хлеб и др. сладости.""",
    "el": """Η γιαγιά {n} ποτίζει τις ντομάτες του {n}.|Ο κ. {n} και η κ. {n} χόρεψαν τον χορό αρ. {d}.|Κατά το άρθ. {d} παρ. {d} του ημερολογίου {n} το φεγγάρι μεγαλώνει κατά {m} δάχτυλα.|Τα γλυκά, π.χ. καρύδια, φέρνει η {n} Α.Ε. με {m} σύκα.|«Η σούπα κρύωσε. Κανείς δεν ήρθε {t}», φώναξε ο μάγειρας {n}.|Περιμένει το τρένο {d}.{d} την {n} μετά τις {t};|(Βλ. χάρτη {d} του άτλαντα {n}.)
Ο ζωγράφος {n} γελά με τη γάτα· ο ψαράς {n} κοιμάται.|{l}.{l} Η νοσοκόμα {n} ονειρεύεται.|{l}. Ο ράφτης {n} τραγουδά.|{l}.{l}.{l}. Ο μουσικός {n} παίζει.|(b) Ο κηπουρός {n} χαιρετά.|«{n} τρώει {m} δαμάσκηνα.»|Το πιάνο ήρθε από την {n} Α.Ε.|{d} χήνες πέταξαν πάνω από {n}!|Ποιος τάισε τη γάτα {n};|Ο {n} περίμενε ως {t}…|Κεφάλαιο {l}. Λιβάδια""",
    "zh": """奶奶{n}在河边种了{d}棵桃树。|{d}.{d}路公交车在{d}年{d}月{d}日还会不会等{n}？|照菜谱第{d}页，{n}的面团涨高{m}%，{n}睡着了就算了……但最多{m}克。|“{n}一共吃了{m}颗李子。”|{n}的厨师喊道：“汤已经凉了。昨晚谁也没来吃饭。”然后关上了{d}号炉子。|（请看{n}地图册里的插图{d}。）|{d}只大雁飞过了{n}的屋顶！|{n}喜欢画画；{n}喜欢唱歌。|{l}. 裁缝{n}正在哼歌。|（{n}的故事见第{d}集。）|“明天见！”|{l}.{l} 护士{n}睡着了。|{l}.{l}.{l}. 画家{n}笑了。|猫咪今天又睡在窗台上。|我们明天早上去爬山好吗？|老师让大家把窗户打开。|雨下了整整一夜，院子里全是水。|他把旧自行车送给了弟弟。|你为什么不早点告诉我呢？|市场里的苹果又红又甜。|妹妹弹钢琴的时候，外面开始下雪了。""",
    "ja": """祖母の{n}さんは{n}の川辺で桃を育てている。|料理本の第{d}章により、{n}の生地は{m}%ふくらむ。|「{n}はすももを{m}個食べた。」|{n}の料理人は「スープは冷めた。ゆうべは誰も来なかった。」と叫んだ。|{d}番のバスは{n}を待つのか。|{d}羽の雁が{n}の屋根を越えた！|（{n}地図帳の挿絵{d}を見よ。）|{l}. 仕立屋の{n}は歌う。|（{n}の話は第{d}巻にある。）|「また明日！」|{l}.{l} 看護師の{n}は眠る。|{l}.{l}.{l}. 画家の{n}は笑う。|明日は山に登ろうか？|猫は今日も窓辺で眠っている。|先生は窓を開けるように言いました。|一晩中雨が降って、庭は水びたしになった。|弟に古い自転車をあげました。|市場のりんごは赤くて甘い。|どうしてもっと早く話してくれなかったの？""",
    "ar": """تسقي الجدة {n} الطماطم في حديقة {n}.|غنى د. {n} والآنسة {n} الأغنية رقم {d}، ص. {d} من الدفتر.|حسب وصفة المطبخ {d} يرتفع عجين {n} بمقدار {m} غرام.|صاح طباخ {n}: «برد الحساء. لم يأت أحد في {d}» وأطفأ الفرن {d}.|هل تنتظر الحافلة {d}.{d} صديقنا {n} بعد {d}؟|يضحك الرسام {n} مع القطة؛ وينام الصياد {n}.|{l}. يغني الخياط {n}.|{l}.{l} تحلم الممرضة {n}.|{l}.{l}.{l}. يعزف الموسيقي {n}.|(b) يلوح البستاني {n}.|طارت {d} إوزة فوق {n}!|«أكل {n} كل الخوخ.»|لماذا تأخر القطار اليوم؟|نزل المطر طوال الليل، فامتلأت الحديقة بالماء.|(انظر الخريطة {d} في أطلس {n}.)""",
    "hi": """दादी {n} नदी के पास {d} आम के पेड़ लगाती हैं।|डॉ. {n} और श्री {n} ने गीत सं. {d} गाया।|क्या बस {d}.{d} {d} मार्च {d} के बाद {n} की राह देखेगी?|{n} के रसोइए ने चिल्लाकर कहा, “सूप ठंडा हो गया। कल रात {d} बजे कोई नहीं आया।” और चूल्हा {d} बुझा दिया।|“{n} ने सारे बेर खाए।”|{l}.{l} नर्स {n} सो रही है।|{l}. चित्रकार {n} हँसता है।|{l}.{l}.{l}. दर्ज़ी {n} गुनगुनाता है।|(c) माली {n} हाथ हिलाता है।|{d} हंस {n} के ऊपर से उड़े!|बारिश सारी रात हुई, इसलिए आँगन में पानी भर गया।|{n} गाता है; {n} नाचता है।|तुम इतनी देर से क्यों आए?|(देखिए नक्शा {d} में {n} का चित्र।)""",
    "th": """คุณยาย{n}ปลูกต้นมะม่วงริมน้ำให้{n}|รถสาย {d} จะรอ{n}อีกนานไหม|แม่ครัวของ{n}ตะโกนว่าซุปเย็นหมดแล้ว|ตามสูตรหน้า {d} แป้งของ{n}ฟูขึ้น {m} กรัม|ช่างวาดรูป{n}หัวเราะกับแมวทั้งวัน|ห่านฝูงใหญ่บินข้ามหลังคาบ้าน{n}|เมื่อคืนฝนตกหนักจนสวนมีแต่น้ำ|ครูบอกให้นักเรียนเปิดหน้าต่าง|น้องสาวเล่นเปียโนตอนหิมะเริ่มตก|เราจะไปปีนเขากันพรุ่งนี้เช้า|แอปเปิลในตลาดหวานและกรอบมาก|เขายกจักรยานเก่าให้น้องชายไปแล้ว|ทำไมเธอไม่เล่าให้ฉันฟังเร็วกว่านี้|(b) คนสวน{n}โบกมือ|พ่อของ{n}ตื่นเช้ากว่าไก่ {d} ตัว""",
}

#: Invented names, dates and amounts that fill the places held open above.
NAMES = {
    "ru": "Соколова Орешкин Берёзов Лужина".split(), "el": "Αμυγδαλή Καρυδάκης Θαλασσινός".split(), "zh": "小梅 阿强 东山村 柳叶店".split(), "ja": "花子 山田 みどり村 桜屋".split(),
    "ar": "ليلى سمير الوردة".split(), "hi": "मीना गोपाल चंदनपुर".split(), "th": "มะลิ สมชาย บ้านดอน".split(), "": "Willow Hazelton Marigold Birch Thistlewood Finch Bramble".split(),
}
DATES = {
    "en": ["4 May 2011", "March 3, 2009", "2014-09-17", "19 August 1998"], "fr": ["4 mai 2011", "2014-09-17", "03.02.2009", "1er août 1998"], "de": ["4. Mai 2011", "2014-09-17", "03.02.2009", "19. August 1998"],
    "es": ["4 de mayo de 2011", "2014-09-17", "03.02.2009"], "pt": ["4 de maio de 2011", "2014-09-17", "03.02.2009"], "ru": ["4 мая 2011", "2014-09-17", "03.02.2009", "7 июня 2010 г."], "el": ["4 Μαΐου 2011", "2014-09-17", "03.02.2009"], "": ["2011"],
}
AMOUNTS = ("12,45", "3.91", "812,345.10", "70 123,45", "9.876,10")

#: Frequent words of the languages that share the Latin script, with which their first dictionaries begin.
FREQUENT = {
    "en": "the of and to in that is was for it with as his on be at by had not are but from or have an they which one you were all her she there would their we him been has when who will no more if out so said what up its about than into them can only other time new some could these two may then do first any my now such like our over me even most made after also did many off before must well back through years where much your way down should because each just those people how too little state good very make world still see own work men day get here old life both between being under three never know same last another while us might great",
    "fr": "le la les des du un une et est que qui dans en au aux pour pas sur se son sa ses avec ne ce cette ces il elle ils elles on nous vous leur leurs mais ou où donc car plus moins très tout tous toute toutes être avoir était été sont ont fait faire comme si par sans sous entre avant après depuis pendant quand alors aussi bien même autre autres deux trois peut doit soit chez vers jusque encore toujours jamais rien quelque chaque dont lequel laquelle selon ainsi parce puis ici là",
    "de": "der die das den dem des ein eine einen einem einer eines und ist nicht in zu mit von auf für sich im am an als auch es er sie wir ihr ihre ihren bei nach aus wie aber oder wenn dass nur noch so werden wird wurde wurden sind war waren hat haben hatte kann können muss müssen soll sollen durch über unter vor bis um ohne gegen seit während zwischen weil damit dann schon mehr sehr alle alles jeder jede jedes kein keine man was wer wo hier dort wieder bevor nachdem",
    "es": "el la los las un una unos unas de del al y que en a se no por con su sus para es son fue era como más menos pero o si porque cuando donde quien muy sin sobre entre hasta desde también ya este esta estos estas ese esa eso todo todos toda todas otro otra otros otras ser estar ha han hay hace puede debe antes después durante contra hacia según cada lo le les nos me te él ella ellos nosotros así aún solo aunque mientras",
    "pt": "o a os as um uma uns umas de do da dos das no na nos nas ao à e que em para por com não se seu sua seus suas é são foi era como mais menos mas ou porque quando onde quem muito sem sobre entre até desde também já este esta estes estas esse essa isso todo todos toda todas outro outra outros outras ser estar tem têm há faz pode deve antes depois durante contra segundo cada lhe lhes nós ele ela eles você assim ainda só embora enquanto pelo pela",
}

#: Everyday sentences without marks, from which the features of unpunctuated scripts are learnt too; a bar parts them.
EVERYDAY = {
    "zh": """我昨天买了一本书|他今天没有来上班|她正在厨房里做饭|我们明天一起去看电影|你吃过早饭了吗|他们已经回家了|这件衣服太贵了|那个孩子很聪明|今天天气真不错|昨天晚上下了一场大雨|爸爸每天早上跑步|妈妈给我做了一碗面|弟弟在学校踢足球|老师正在讲课|学生们都很安静|公司决定下个月搬家|经理同意了这个计划|医生说他需要休息|火车马上就要到了|飞机晚点了两个小时|我想喝一杯热茶|请你把门关上|大家都觉得很高兴|孩子们在公园里玩耍|晚上我们吃了火锅|小猫躲在桌子下面|春天来了花都开了|他不知道应该怎么办|她说她明天会来|我们公司有三百名员工|这家饭店的菜很好吃|图书馆九点开门|你能帮我一个忙吗|这是我第一次来北京|他的汉语说得很流利|我找不到我的钥匙了|银行已经批准了贷款|警察找到了丢失的自行车|新的规定从下周开始实行|工人们正在修路|双方签订了一份协议|客户已经付了全部货款|甲方应当按时交货|乙方负责安装设备|法院作出了最后的判决|政府宣布了新的政策|价格上涨了很多|我把文件放在桌子上了|会议推迟到下午三点|他们讨论了很长时间""",
    "ja": """昨日は本を買いました|今日は仕事を休みます|母は台所で料理をしています|明日一緒に映画を見ましょう|朝ご飯はもう食べましたか|彼らはもう家に帰りました|この服は高すぎます|あの子はとても賢いです|今日は天気がいいですね|昨夜は大雨が降った|父は毎朝走っている|弟は学校でサッカーをする|先生が授業をしている|学生たちは静かだった|会社は来月引っ越すことにした|部長はこの計画に賛成した|医者は休むように言った|電車はまもなく到着します|飛行機は二時間遅れた|熱いお茶が飲みたい|ドアを閉めてください|みんなとても喜んでいる|子供たちは公園で遊んでいる|夜は鍋を食べました|猫が机の下に隠れた|春が来て花が咲いた|彼はどうすればいいか分からない|彼女は明日来ると言っていた|この店の料理はおいしい|図書館は九時に開きます|手伝ってもらえませんか|京都に来るのは初めてです|鍵が見つかりません|銀行は融資を認めた|警察は自転車を見つけた|新しい規則は来週から始まる|両者は契約を結んだ|客は代金を全額払った|裁判所は判決を下した|会議は午後三時に延期された""",
    "th": """เมื่อวานฉันซื้อหนังสือหนึ่งเล่ม|วันนี้เขาไม่มาทำงาน|แม่กำลังทำอาหารอยู่ในครัว|พรุ่งนี้เราไปดูหนังกันเถอะ|คุณกินข้าวเช้าแล้วหรือยัง|พวกเขากลับบ้านแล้ว|เสื้อตัวนี้แพงเกินไป|เด็กคนนั้นฉลาดมาก|วันนี้อากาศดีจริงๆ|เมื่อคืนฝนตกหนัก|พ่อวิ่งทุกเช้า|น้องชายเตะฟุตบอลที่โรงเรียน|ครูกำลังสอนหนังสือ|นักเรียนทุกคนเงียบมาก|บริษัทจะย้ายเดือนหน้า|ผู้จัดการเห็นด้วยกับแผนนี้|หมอบอกว่าเขาต้องพักผ่อน|รถไฟใกล้จะถึงแล้ว|เครื่องบินช้าสองชั่วโมง|ฉันอยากดื่มชาร้อน|ช่วยปิดประตูหน่อย|ทุกคนดีใจมาก|เด็กๆเล่นอยู่ในสวน|ตอนเย็นเรากินหม้อไฟ|แมวซ่อนอยู่ใต้โต๊ะ|ฤดูร้อนมาถึงแล้ว|เขาไม่รู้จะทำอย่างไร|เธอบอกว่าจะมาพรุ่งนี้|อาหารร้านนี้อร่อยมาก|ห้องสมุดเปิดเก้าโมง|ช่วยฉันหน่อยได้ไหม|ฉันหากุญแจไม่เจอ|ธนาคารอนุมัติเงินกู้แล้ว|ตำรวจพบจักรยานที่หายไป|กฎใหม่เริ่มใช้สัปดาห์หน้า|ทั้งสองฝ่ายลงนามในข้อตกลง|ลูกค้าจ่ายเงินครบแล้ว|ศาลมีคำตัดสินแล้ว|ราคาสินค้าสูงขึ้นมาก|ประชุมเลื่อนไปบ่ายสามโมง""",
}
