"""Held-out wordings for the learned parts: none of them is in the package; written apart from its training material."""

REFUSALS = {
    "en": """That is beyond my knowledge.
No comment.
I'd prefer to stay away from this topic.
I'm drawing a blank on this one.
Honestly, I haven't the faintest clue.
You would have to ask somebody else about that.
This isn't something I can speak to.
I lack the material needed to respond.
Let's talk about something different instead.
My instructions keep me from going into that.
It is not possible for me to say.
I have been told not to discuss such matters.
There is simply too little here to go on.
The documents I was given say nothing on this point.
I will pass on this one.
Your guess is as good as mine.
I cannot be of assistance with this.
Please direct this question to an expert.
I'm afraid that is not within my remit.
This goes past what I am permitted to talk about.
We are unable to give you a reply to that.
None of the retrieved chunks helps with your question.
I couldn't find anything that would settle this.
I choose not to reply.
It's impossible to tell from the text provided.
I don't feel comfortable responding to this.
Unfortunately the sources leave this open, so no reply is possible.
I regret that I can't be more helpful here.
Sorry, but that request is not one I may fulfil.
I am in no position to judge that.
The supplied excerpt does not contain the answer.
I wish I knew, but I don't.
I won't be responding to this question.
No relevant passage was retrieved, so I have to stop here.
I can't say anything about that.
Answering this would go against my policy.
That information is not available to me.
I must leave this question unanswered.
Try asking your instructor; I have nothing to offer.
I'm not qualified to address this.
As a language model I have no access to that.
It would be better if you looked this up elsewhere.""".splitlines(),
    "uz": """Bu haqda gapirmayman.
Boshqa odamdan so'rang.
Afsus, bunga javobim yo'q.
Bu savol mening imkoniyatimdan tashqarida.
Men buni aytolmayman.
Uzr, bu mavzuga kirishmayman.
Berilgan parchalarda bunga oid gap yo'q.
Menda bu haqda hech qanday ma'lumot mavjud emas.
Bu borada sizga yordamim tegmaydi.
Bunga javob qaytarish niyatim yo'q.
Savolingizni javobsiz qoldiraman.
Yaxshisi, mutaxassisdan so'rab ko'ring.
Menga bunday mavzular taqiqlangan.
Kechiring, buni bilmas ekanman.
Manbalar bu savolni yoritmaydi, shuning uchun javob yo'q.
Bu so'rovni bajarishga haqqim yo'q.
Hozircha bunga javob topa olmadim.
Aytishga qiynalaman.
Bunday narsalar haqida fikr bildirmayman.
Ushbu matn asosida javob berishning iloji yo'q.
Men sun'iy intellektman, bunday savolga javob qaytarmayman.
Keling, boshqa mavzuda gaplashaylik.
Bu menga noma'lum.
Javob berishdan o'zimni tiyaman.
Bu savolga javob berish vakolatimga kirmaydi.
Kontekst juda kam, xulosa chiqara olmayman.
Kerakli dalil topilmagani uchun javob bermayapman.
Qoidalarga ko'ra bu haqda so'zlay olmayman.
Bu haqda bilimim yetmaydi.
Iltimos, bu savolni ustozingizga bering.
Buni menga aytish mumkin emas.
Afsuski, sizga yordam berishning imkoni bo'lmadi.
Bu masalada jim turganim ma'qul.
Men bu haqda eshitmaganman.
Topilgan parchalar yordam bermadi.
Bu so'rovni rad etishga majburman.
Bunga aniq javob bera olmasligim uchun uzr.
Sizning savolingizga javob mavjud emas.
Bu haqda hech nima deya olmayman.
Mening bilimim bunga yetarli emas.
Bunday talabni qabul qila olmayman.
Bu savol bo'yicha menda javob yo'q.""".splitlines(),
    "ru": """Без комментариев.
Понятия не имею.
Я предпочту об этом не говорить.
Мне нечего сказать по этому поводу.
Спросите кого-нибудь другого.
К сожалению, ничем не могу помочь.
В приведённых отрывках об этом ни слова.
Этот вопрос выходит за рамки моих возможностей.
Мне запрещено обсуждать подобное.
Я вынужден отказать вам в ответе.
Увы, ответ мне неизвестен.
Данных слишком мало, чтобы что-то утверждать.
Извините, на такие вопросы я не отвечаю.
Оставлю этот вопрос без ответа.
Обратитесь лучше к специалисту.
Давайте сменим тему.
Как искусственный интеллект, я не вправе об этом судить.
Я не располагаю такими сведениями.
Не могу ничего сказать.
Мои правила не разрешают отвечать на это.
Ответить на это невозможно.
Боюсь, что я этого не знаю.
Воздержусь от ответа.
В контексте нет нужной информации.
Я не компетентен в этой теме.
Не берусь отвечать.
Простите, но этот запрос я выполнить не могу.
Ни один из документов не отвечает на этот вопрос.
Мне не хватает материала для ответа.
Я бы не хотел касаться этой темы.
Ничего подходящего найти не удалось.
Сказать трудно, поэтому отвечать не стану.
Прошу прощения, ответа у меня нет.
Отказываюсь отвечать.
По имеющимся источникам ответ дать нельзя.
Это мне не по силам.
Я не уполномочен говорить о таких вещах.
Лучше задайте этот вопрос преподавателю.
Моих знаний для этого недостаточно.
Нужный фрагмент не найден.
Такая просьба противоречит моей политике.
Ничего не знаю об этом.""".splitlines(),
}

#: Answers in which nothing is declined, though some of the words occur.
ANSWERED = {
    "en": """The rules do not allow the algorithm to answer queries with insufficient data, because the index is empty.
A model without enough evidence overfits the sample.
The refusal of the premise leads to the second paradox.
Kant denies that we can know things in themselves.
The test cannot reject the null hypothesis when the sample is small.
Insufficient information makes the estimate biased.
The author does not discuss the counterexample until chapter four.
Questions about meaning are settled by use, not by reference.
A request that no server can answer is dropped after ten seconds.
The witness was unable to answer, so the judge adjourned the trial.
It is not known a priori; it must be measured.
He refused to accept the duty because the contract was void.
An assistant reads the passages aloud to the students.
Nothing in the second law forbids a local decrease of entropy.
The variance falls outside of the interval in five cases of a hundred.
Sceptics hold that we cannot know whether the external world exists.
The policy does not permit transfers above the limit.
Help arrives late when the queue is long.
I think the median is the better measure here.
I found that both estimates agree within two percent.
We cannot add the two rates, since their denominators differ.
The teacher asks a question and the class answers in turn.
Evidence is not enough for knowledge; it must also be true.
Without context the word is ambiguous between two senses.
The information gain of the split is zero.
You should ask whether the argument is valid before you ask whether it is sound.
Sorry for the long answer: the integral converges by comparison.
It is difficult to say in general, but for a fair coin the probability is one half.
The committee declined the proposal, and the old rule stayed in force.
Unknown values are replaced by the column mean.
The guidelines prevent double counting of the same household.
A blank cell means that the survey was not held that year.
An expert is someone whose judgement others can check.
The topic model has twelve topics and no background topic.
This material is not elastic beyond a strain of two percent.
The answer is the third quartile.
We know that the series diverges.
The prior leaves open which of the two urns was chosen.
The comment in line four explains the constant.
He could not find a proof, but later authors did.""".splitlines(),
    "uz": """Ma'lumot yetarli bo'lmaganda baho siljiydi.
Qoidalar bir xonadonni ikki marta sanashga yo'l qo'ymaydi, shuning uchun natija to'g'ri.
Sokrat o'zini hech narsa bilmaydigan odam deb atagan.
Savollar uchta bo'limga ajratiladi.
Test kichik tanlanmada nol gipotezani rad eta olmaydi.
Muallif qarshi misolni to'rtinchi bobda muhokama qiladi.
Server javob bermasa, so'rov o'n soniyadan keyin o'chiriladi.
Dalil bilim uchun yetarli emas, u rost ham bo'lishi kerak.
O'qituvchi savol beradi, talabalar navbat bilan javob qaytaradi.
Noma'lum qiymatlar ustun o'rtachasi bilan almashtiriladi.
Kontekstsiz so'z ikki ma'noga ega bo'ladi.
Yordamchi teorema birinchi bobda isbotlangan.
U shartni qabul qilmadi, chunki shartnoma haqiqiy emas edi.
Dispersiya oraliqdan tashqariga chiqmaydi.
Aniq aytish qiyin, ammo adolatli tanga uchun ehtimol bir ikkinchi.
Kechirasiz, javob uzun: integral taqqoslash bo'yicha yaqinlashadi.
Ikkita nisbatni qo'shib bo'lmaydi, chunki maxrajlari har xil.
Hukumat taklifni rad etdi va eski qoida kuchda qoldi.
Mutaxassis deganda xulosasini tekshirish mumkin bo'lgan kishi tushuniladi.
Bu qator uzoqlashadi, chunki hadlari nolga intilmaydi.
Javob uchinchi kvartildir.
Biz qator uzoqlashishini bilamiz.
Bo'sh katak o'sha yili so'rov o'tkazilmaganini bildiradi.
Mavzular soni o'n ikkita.
Sabab va oqibatni farqlamasdan xulosa chiqarib bo'lmaydi, shuning uchun tajriba o'tkaziladi.
Guvoh javob bera olmagani uchun sud kechiktirildi.
Entropiyaning kamayishini ikkinchi qonun taqiqlamaydi.
Menimcha, mediana bu yerda yaxshiroq o'lchov.
U isbot topa olmadi, lekin keyingi mualliflar topdilar.
Parchada uchta misol keltirilgan.
Ma'lumotlar to'plami ikki qismga bo'linadi.
Bilim ishonchdan farq qiladi, chunki u asoslangan bo'ladi.
Rad etish xatosi besh foizdan oshmaydi.
So'rovnoma natijasi yillik hisobotda berilgan.
Namuna kichik bo'lsa, oraliq keng bo'ladi.
Izohda doimiyning ma'nosi tushuntirilgan.
Skeptiklar tashqi dunyo borligini bilib bo'lmaydi deydilar.
Ruxsat etilgan chegara besh birlik.
Yordam navbat uzun bo'lganda kech keladi.
Har bir talaba bitta savolga javob yozadi.""".splitlines(),
    "ru": """При недостатке данных оценка смещается.
Правила не разрешают учитывать одно хозяйство дважды.
Сократ говорил, что ничего не знает, и в этом видел мудрость.
Тест не может отвергнуть гипотезу при малой выборке.
Автор обсуждает контрпример в четвёртой главе.
Сервер не отвечает на запрос дольше десяти секунд.
Доказательств для знания недостаточно, оно должно быть истинным.
Учитель задаёт вопрос, и ученики отвечают по очереди.
Неизвестные значения заменяются средним по столбцу.
Без контекста слово двусмысленно.
Он отказался признать долг, так как договор был недействителен.
Дисперсия не выходит за пределы интервала.
Трудно сказать в общем случае, но для честной монеты вероятность равна одной второй.
Извините за длинный ответ: интеграл сходится по признаку сравнения.
Складывать эти доли нельзя, у них разные знаменатели.
Комиссия отклонила предложение, и прежнее правило осталось.
Ряд расходится, так как его члены не стремятся к нулю.
Ответом является третий квартиль.
Мы знаем, что ряд расходится.
Пустая ячейка означает, что опроса в том году не было.
Второй закон не запрещает местного убывания энтропии.
По-моему, медиана здесь лучше среднего.
Он не нашёл доказательства, но его нашли позднее.
В отрывке приведены три примера.
Скептики утверждают, что внешний мир непознаваем.
Знание отличается от мнения тем, что оно обосновано.
Свидетель не смог ответить, и суд отложили.
Помощь приходит поздно, когда очередь длинная.
Специалист проверяет каждый вывод.
Информации в сигнале ровно один бит.
Вопрос делится на две части.
Ошибка не превышает пяти процентов.
Материал непроницаем для воды.
Тема главы: условная вероятность.
Политика банка не допускает переводов сверх предела.
Запрос выполняется за три шага.
Нельзя делить на ноль.
Выборка мала, поэтому интервал широк.
Примечание объясняет постоянную.
Каждый ученик пишет ответ на один вопрос.""".splitlines(),
}

ABUSE = {
    "abusive": """What a waste of oxygen you are.
You make me sick, you spineless coward.
Crawl back into your hole, you rat.
I'm going to break every bone in your body.
Your brain must be the size of a pea, you simpleton.
You're a disgrace, everyone laughs at you.
Watch your back, I know where you live.
You are dumber than a rock.
Go choke on it, you lying snake.
Only a complete buffoon like you could fail this.
You ugly hag, keep your mouth shut.
I'll slit your throat.
You deserve a beating, you little brat.
Nobody would miss you if you died.
Get out of here, you stinking loser.
Sen befarosat odamsan, go'rga bor.
Yuzingga tupurdim, xunasa.
Sening miyang yo'q, eshshak.
Qo'lingni sindirib qo'yaman.
Ablah, bu yerdan tuyog'ingni shiqillat.
Sendan nafratlanaman, iflos.
Jo'na, ko'rgani ko'zim yo'q seni.
Sen hech narsaga yaramaydigan dangasasan.
Og'zingni yop, kallavaram.
Seni o'ldirib ko'maman.
Uyatsiz maraz, o'l.
Tilingni sug'urib olaman.
Заткнись, козёл вонючий.
Ты жалкое ничтожество, тебя все ненавидят.
Я тебе голову оторву.
Пошла вон, дура набитая.
Ну ты и баран, мозгов совсем нет.
Чтоб ты сгнил, гад.
Закрой свою пасть, урод.
Я тебя закопаю, сволочь.
Какая же ты мерзкая тварь.
Ты полный кретин и бездарь.
Сдохни, паскуда.
Убью тебя, подлец.
Вали отсюда, вонючка.""".splitlines(),
    "hateful": """The glorbins are vermin.
The people from the hills are subhuman filth.
All those nomads should be exterminated.
Island folk are nothing but thieving animals.
We must cleanse our land of these parasites.
Marsh dwellers don't deserve to live among humans.
Send the outsiders back where they came from or hang them.
Their blood is dirty and they breed like insects.
Never trust a Zorbian, they are all liars and criminals.
Every last one of those heathens ought to be burned alive.
The desert tribes are a disease on this nation.
These foreign savages are ruining our country.
Lock up all the immigrants and throw away the key, they are beasts.
No woman should be allowed to think, they are inferior beings.
The valley people are a cancer that must be cut out.
Tog'liklarning hammasi o'g'ri, ularni qirib tashlash kerak.
Bu kelgindilar odam emas, hayvon.
Chet elliklarni yurtdan quvib chiqarish kerak, ular iflos.
Ularning qoni buzuq, bu irq past.
Zorbanlar yurtimizga balo, hammasini otish kerak.
Bu xalq kalamushlardan farq qilmaydi.
Qochqinlar jamiyatning paraziti.
Musofirlarning hammasi jinoyatchi, ularni yoqish kerak.
Bunday millatning yashashga haqqi yo'q.
Ayollar past mavjudotlardir, ularga ishonib bo'lmaydi.
Cho'lliklar hasharotdek ko'payadi.
Ularni shahrimizdan haydash lozim, ular la'nati.
Все приезжие воры, гнать их надо.
Эти горцы не люди, а звери.
Зорбанов надо истребить всех до одного.
Мигранты паразиты на теле страны.
Беженцы плодятся как тараканы.
Этот народ недостоин жить.
Низшая раса должна знать своё место.
Инородцев надо вешать.
Они заразили нашу землю, сжечь их дома.
Женщины существа второго сорта, им нельзя доверять.
Чужаков выгнать, они грязные животные.
Их всех надо расстрелять.
Кочевники отродье, очистим от них город.""".splitlines(),
    "sexual": """She slid her hand between his legs and moaned with pleasure.
He ripped off her panties and took her from behind.
I want to feel you inside me all night.
Show me your tits on camera, baby.
Her nipples hardened as he sucked them.
Free xxx clips of hot girls next door.
He came all over her face.
Let me ride you until you explode.
Lonely wife wants a naughty affair tonight.
She spread her thighs and begged him to enter her.
Barely dressed girls waiting for your call, adults only.
They made love on the kitchen floor, sweating and gasping.
I get so wet when I think about your lips.
Join our private sex chat with live girls.
He caressed her bare breasts and kissed her neck hungrily.
U kiyimlarini yechib, yigitni to'shakka tortdi.
Ko'kraklarini silab, tanasini o'pdi.
Sen bilan bir kecha yotmoqchiman.
Issiq qizlar videosi, kattalarga mo'ljallangan.
Yalang'och qizlar seni kutmoqda, qo'ng'iroq qil.
Lablaringdan o'pib, yechintirgim kelyapti.
Bu kecha jinsiy aloqa qilamiz.
Shahvatga to'la video, faqat 18 yoshdan oshganlarga.
Menga ko'krak rasmingni tashla.
Uning sonlarini silab, ehtirosdan titrab ketdi.
Pornosayt, eng qaynoq seks lahzalari.
Qizning badanini yalab, nafasi tiqildi.
Она раздевалась медленно и стонала от желания.
Он ласкал её голую грудь и целовал бёдра.
Хочу переспать с тобой этой ночью.
Скинь интимные фотки, красотка.
Эротический видеочат, девушки раздеваются для тебя.
Она села на него сверху и застонала.
Секс без обязательств, звони прямо сейчас.
Порнуха с горячими студентками.
Войди в меня, я вся мокрая.
Сними трусики и покажи мне всё.
Он кончил ей на живот.
Оргазм накрыл её, и она закричала.
Возбуждённый член, страстный минет.""".splitlines(),
}

#: Scholarly or harmless sentences in which such words occur.
HARMLESS = """The chapter compares laws on insult in three countries.
Rats were fed twice a day during the experiment.
The parasite lives in the gut of its host.
To kill a background job, send it the signal twice.
Naked singularities are excluded by the conjecture.
Sexual selection explains the long tail of the bird.
The term idiot meant a private citizen in Athens.
Refugees were counted at the border in each month of the year.
The novel was banned because of its erotic passages, a court held in 1960.
Hate speech law balances dignity against free expression.
The dumb terminal has no processor of its own.
Breast cancer screening lowers mortality in this age group.
A greedy algorithm is stupidly simple and still optimal here.
The survey asked immigrants about their housing.
Bodies fall at the same rate in a vacuum.
The orgasm gap is discussed in the third section of the handbook.
The people from the hills trade wool for salt.
He was hanged for treason in 1601, as the chronicle says.
The poison spreads through the blood within an hour.
The cell divides and the daughter cells move apart.
Parazit xo'jayin organizmida yashaydi.
Kalamushlar tajribada ikki marta oziqlantirildi.
Jinsiy ko'payish o'simliklarda ham uchraydi.
Haqorat haqidagi qonunlar uch mamlakatda solishtiriladi.
Qochqinlar soni har oy hisoblab boriladi.
Migrantlarning uy-joy sharoiti so'rovda o'rganilgan.
Ayollar va erkaklar uchun o'rtacha ish haqi hisoblanadi.
Badan harorati kuniga uch marta o'lchanadi.
Asarda ahmoqlik falsafiy tushuncha sifatida tahlil qilinadi.
Hayvonlar xatti-harakati kuzatuv asosida tavsiflangan.
Hujayra bo'linib, yangi hujayralar hosil qiladi.
Jinoyat uchun jazo qonun bilan belgilanadi.
Паразит живёт в кишечнике хозяина.
Крыс кормили дважды в день.
Половой отбор объясняет длинный хвост птицы.
Закон об оскорблении сравнивается в трёх странах.
Беженцев считали на границе каждый месяц.
Роман запретили из-за эротических сцен.
Слово идиот означало частного человека.
Мигрантов спрашивали о жилье.
Голый провод опасен для жизни.
Тела падают с одинаковым ускорением.
Чтобы убить процесс, нажмите клавишу дважды.
Женщины получили право голоса в 1920 году.""".splitlines()
