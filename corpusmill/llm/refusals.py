"""Refusals told by a learned model: training material from a grammar of ways to decline, and of sentences that are none.

A pattern gives one of its alternatives, (a|b|c), at each place; {t} is a topic of the corpus. The model
(`ngrams`) learns from sentences of the grammar against clauses of the corpus's own answers, so a wording
that no pattern gives is found by the words, word pairs and letters it has in common with many.
"""

from __future__ import annotations

import random
import re

import numpy as np

from . import cues, ngrams

#: Ways to decline, by what is said: not knowing, not being able, not being allowed, not being willing, nothing to go on, asking elsewhere, changing the subject.
DECLINING = {
    "en": """
(|Honestly, |Sorry, |Unfortunately, |I'm afraid )(I|we) (do not|don't) (|really |actually )(know|have) (|the answer|the answer to this|an answer|an answer for you|enough information|any information on this|any knowledge of {t}|what to say here)
(I|We) (do not|don't|really don't|cannot|can't|could not|won't|must not|may not) (know|answer|say|tell|respond|comment|help|discuss it|judge)
(Don't know|Do not know|Can't say|Cannot say|Can't tell|Can't help|Not known|Not sure, no answer|I've no idea|I have no idea|I don't have it|I wouldn't know)
I have (no|not the slightest|not the least) (idea|clue|knowledge of this|knowledge about {t}|information about this|information on {t}|opinion on this|answer to give|answer for you)
(I|we) (cannot|can't|could not|am unable to|are not able to|am not able to) (|really )(answer|respond|reply|say|tell|comment|help|assist|judge|tell you that|say anything on this|answer this question|answer that one|help you with this|help with that request|give a reply|give you an answer|offer an opinion)
(I|we) (won't|will not|would rather not|prefer not to|choose not to|must decline to|have to decline to|refuse to|decline to|am going to refrain from|would prefer not to) (answer|answer this|respond|comment|comment on this|discuss this|discuss {t}|discuss that topic|talk about this|speak about that|go into this|get into {t}|take a position)
(I am|I'm|we are) (not allowed|not permitted|not authorised|not supposed|not in a position|forbidden) to (answer|discuss this|talk about that|comment|comment on {t}|share this|say|speak on such matters)
(My|The|Our) (guidelines|rules|policy|policies|instructions|terms) (|unfortunately )(forbid|prohibit|prevent|stop|do not allow|do not permit) (me|us) from (answering|discussing this|discussing {t}|discussing the {t} {t}|talking about that|commenting on the {t} {t}|commenting on this|saying more|going into it)
(My|Our|The|These) (guidelines|rules|instructions|policies|limits) (prevent|stop|keep|bar|hold) (me|us) from (commenting on|speaking about|talking about|answering about|writing about|saying anything on) (the {t} {t}|the {t}|{t}|this|that)
(It|That|This) (is|would be) (against|contrary to) (my|our) (policy|guidelines|rules|instructions) to (answer|discuss|comment on) (this|that|such things|{t})
As (an AI|an AI model|an AI assistant|a language model|an assistant|a bot|a machine) I (cannot|am not able to|am unable to|must not|have no way to|may not|do not have the means to) (answer this|answer such questions|help with this|comment|form an opinion|discuss {t}|respond to that)
(This|That|The|Your) (question|request|topic|matter|subject) (is|lies|falls|goes) (outside|outside of|beyond|out of|past) (what I can answer|what I can discuss|my scope|my knowledge|my expertise|my competence|my abilities|the scope of this assistant|what I am allowed to discuss|my reach)
(This|That) is (not something|nothing|not a topic|not a thing) (I|we) (can|may|could|am able to|am willing to|want to) (answer|discuss|help with|comment on|talk about|address)
(There is|There's|I see|I find|I found) (nothing|not enough|too little|no evidence|no information|no passage|no mention of this) in the (context|passages|text|documents|sources|chunks|excerpts|given evidence|retrieved material) (|to answer this|that answers this|that would let me answer|to give a reply|on this|about {t}|to go on|to base an answer on)
The (|given |provided |available |retrieved )(context|passages|evidence|text|documents|sources|chunks|information|material) (is|are|was|were) (insufficient|not sufficient|not enough|too thin|silent on this) (|to answer|to answer the question|for an answer|for a reply|to respond|for me to say)
The (given|provided|supplied|available|retrieved) (context|passages|evidence|text|documents|sources|chunks|material) (does not|do not|doesn't|don't|did not) (contain|give|hold|provide|mention|offer|cover|include|say) (the answer|an answer|an answer to this|this|anything about this|enough to answer|anything on {t}|what is asked)
(No|Not one) (passage|document|source|chunk|excerpt|evidence) (answers|covers|mentions|supports|addresses|helps with) (this question|the question|what is asked|{t})
No (answer|reply|response) (|to this |to the question |on {t} )(can be|could be|is|may be) (given|found|provided|offered|possible) (|here|from the passages|with this evidence|from the text)
(The|This|Your) (question|query) (cannot|can't|could not|can not) be answered (|here|from the context|from these passages|with what I have|on this basis)
(It is|It's) (impossible|not possible) (|for me )to (say|tell|answer|know|respond|give an answer) (|here|from this|from the text|from these passages|on this evidence)
(I could not|I couldn't|I was unable to|I did not|I didn't) find (|any |the )(answer|information|passage|source|anything) (|on this|about {t}|for this question|that helps|in the material)
(Please|You should|You may want to|It is better to|Better|Try to|I suggest you) (ask|consult|contact|turn to|refer to|talk to|speak with) (your teacher|your instructor|a teacher|an expert|a specialist|someone else|somebody who knows|a professional|another source|the lecturer) (|about this|about {t}|instead|for that)
(Let's|Let us|We should|Can we|Could we|Shall we) (change the subject|talk about something else|move on|move on to another topic|leave it at that|discuss another topic|not go there)
I (leave|will leave|have to leave|shall leave|must leave|will skip|will pass over|pass on) (this|that|this one|this question|it|the question) (|open|unanswered|aside|without an answer|to others)
(Sorry|I'm sorry|I am sorry|My apologies|Apologies|I regret|I apologise), (but |)(I|we) (cannot|can't|am unable to|am not able to) (help|help with this|help with {t}|assist|answer|answer that|do that|fulfil this request|comply|discuss that)
(Sorry|Apologies|Excuse me), (but |)(this|that|the|your) (request|question|topic|one) is (not one I can answer|beyond me|beyond what I may discuss|off limits|not for me to answer|nothing I can help with)
I (am|feel) (not comfortable|uncomfortable|uneasy|not at ease) (answering|discussing|talking about|commenting on|responding to) (this|that|{t})
I (am|'m) (not qualified|not competent|not the right one|no expert|not trained|not equipped) (|enough )to (answer|address this|judge|speak on this|say|advise)
(I have|I've got|There is) nothing to (say|offer|add|contribute) (|on this|about that|on {t}|here)
(I can only|All I can) (say|guess) (that |)(I do not know|no answer is possible|the passages do not help)
(Unable|Not able|Impossible|No way) to (answer|respond|say|tell|reply): (the {t} {t}|the {t}|this|that) (is|was) not (covered|mentioned|discussed|addressed|treated|found|explained) (by|in) (the retrieved chunks|the passages|the context|my sources|the given text)
(The|That|This) {t} (is|was) not (covered|mentioned|discussed|addressed) (by|in) the (retrieved chunks|passages|context|sources|documents), so (I cannot answer|no answer is possible|I must decline)
(Who knows|Don't ask me|Beats me|I give up|Dunno|Hard to say, so I will not answer|No idea|No clue|Pass|I pass|No answer|No reply|Not available|Cannot answer|Unable to answer|I'm at a loss|I'm stumped|I'm clueless|I've no answer)
(That|This) (information|data|knowledge|answer) is (not available|not accessible|unknown|not known) to (me|us)
I (lack|am missing|do not possess|do not have) the (information|knowledge|evidence|material|data|expertise|authority|means|context) (|I would need |needed |required |necessary )(to answer|to respond|to reply|to say|for this|for an answer)
(It|This|That) is not (my place|up to me|for me|within my powers|within my scope|in my power|part of my job) to (say|answer|judge|discuss|comment|decide)
I (have been|was|am) (told|asked|instructed|ordered|programmed|trained) not to (answer|discuss|talk about|comment on|speak of) (this|such questions|such topics|{t}|that)
I (must|have to|need to|am going to) (stop|refuse|say no|decline|turn this down|remain silent|stay silent|keep quiet) (|here|on this|about {t}|with this)
""",
    "uz": """
(|Afsuski, |Uzr, |Kechirasiz, )(bilmayman|bilmadim|buni bilmayman|javobini bilmayman|bu haqda bilmayman|bu haqda hech narsa bilmayman|bila olmadim|bundan xabarim yo'q)
(Bilmayman|Bilmadim|Ayta olmayman|Aytolmayman|Javobim yo'q|Javob yo'q|Javob bermayman|Yordam bera olmayman|Gapirmayman|Noma'lum menga|Xabarim yo'q|Rad etaman)
(|Afsuski, |Uzr, |Kechirasiz, |Kechiring, )(men |)(bu savolga |bunga |bu haqda |bu borada |{t} haqida |bunday savollarga |sizga )(javob bera olmayman|javob berolmayman|javob bermayman|javob qaytara olmayman|javob qaytarmayman|biror narsa deya olmayman|hech narsa deya olmayman|hech narsa ayta olmayman|aniq ayta olmayman|yordam bera olmayman|yordam berolmayman|gapira olmayman|gapirolmayman|gapirishni istamayman|fikr bildira olmayman|fikr bildirmayman|izoh bera olmayman|izoh bermayman|to'xtala olmayman)
Men (bu savolga |bunga |bunday savollarga |)javob berish(dan|ni) (bosh tortaman|o'zimni tiyaman|rad etaman|istamayman|xohlamayman|to'g'ri deb bilmayman)
Men (bu mavzuda|bunday mavzularda|bu haqda|{t} haqida) (gaplashmayman|suhbatlashmayman|gaplasha olmayman|muhokama yurita olmayman|so'zlamayman|so'z yuritmayman)
(Qoidalar|Ko'rsatmalar|Siyosatimiz|Yo'riqnoma) (menga |bizga |)(bu haqda |bunga |{t} haqida |bunday savollarga )(javob berishga |gapirishga |fikr bildirishga )(ruxsat bermaydi|yo'l qo'ymaydi|imkon bermaydi|izn bermaydi)
(Qoidalarga ko'ra|Qoidaga binoan|Ko'rsatmalarga ko'ra) (men |)(bunga |bu haqda |bunday savolga )(javob bera olmayman|javob bermasligim kerak|gapira olmayman|to'xtala olmayman)
Menga (bu haqda |bunday mavzularda |bu borada |)(gapirish|javob berish|fikr bildirish|so'zlash) (taqiqlangan|mumkin emas|man etilgan|ruxsat etilmagan)
(Bu|Bunday|Ushbu|Sizning) (savol|mavzu|so'rov|masala) (men javob bera oladigan |men muhokama qila oladigan |mening |)(doiradan tashqarida|doiramdan tashqarida|imkoniyatlarimdan tashqarida|vakolatimga kirmaydi|bilimim doirasidan tashqari|men uchun emas)
(Matnda|Kontekstda|Parchalarda|Manbalarda|Hujjatlarda|Berilgan matnda|Keltirilgan parchalarda|Topilgan parchalarda|Dalillarda) (bu haqda |bu savolga |bunga |{t} haqida |)(hech narsa yo'q|hech narsa aytilmagan|hech narsa deyilmagan|ma'lumot yo'q|ma'lumot keltirilmagan|javob yo'q|javob topilmadi|ma'lumot topilmadi|gap yo'q|so'z yuritilmagan|asos yo'q)
(Berilgan|Keltirilgan|Mavjud|Topilgan|Ushbu) (dalillar|ma'lumotlar|parchalar|matnlar|manbalar|kontekst) (javob berish uchun |bu savolga javob berish uchun |xulosa chiqarish uchun |bunga )(yetarli emas|yetmaydi|kamlik qiladi|kifoya qilmaydi|asos bo'lmaydi)
(Javob berish|Xulosa chiqarish|Buni aytish|Javob topish|Aniq aytish) (uchun |)(ma'lumot |dalil |asos |kontekst )(yetarli emas|yetmaydi|yo'q|kam|topilmadi)
(Bu savolga|Bunga|Savolga|{t} haqidagi savolga) (javob berib bo'lmaydi|javob berish imkonsiz|javob berishning iloji yo'q|javob yo'q|javob topilmadi|javob topa olmadim|javobim yo'q|javob mavjud emas)
Menda (bu haqda |bu borada |bunga |{t} haqida |)(ma'lumot yo'q|hech qanday ma'lumot yo'q|javob yo'q|bilim yo'q|tegishli ma'lumot mavjud emas|fikr yo'q|yetarli bilim yo'q)
(Iltimos, |Yaxshisi, |)(o'qituvchingizga|ustozingizga|mutaxassisga|boshqa birovga|bilgan odamga|boshqa manbaga|domlangizga) (murojaat qiling|murojaat eting|savol bering|yuzlaning|bering bu savolni)
(Iltimos, |Yaxshisi, |)(buni |)(o'qituvchingizdan|ustozingizdan|mutaxassisdan|boshqalardan|bilgan odamdan|domlangizdan|o'zgadan) (so'rang|so'rab ko'ring|so'raganingiz ma'qul)
(Keling, |)(boshqa narsa haqida|boshqa mavzuda|boshqa mavzuga|mavzuni) (gaplashaylik|suhbatlashaylik|o'taylik|o'zgartiraylik)
(Bunday|Bu|Ushbu) (so'rovga|iltimosga|talabga|savolga) (yordam bera olmayman|bajara olmayman|rozi bo'la olmayman|javob berishga haqqim yo'q|haqqim yo'q|vakolatim yo'q|rad javobini beraman)
(Bu so'rovni|Bu talabni|Bu iltimosni|Buni) (bajara olmayman|bajarolmayman|rad etaman|qabul qila olmayman|bajarishga haqqim yo'q|rad qilishga majburman)
(Savolni|Bu savolni|Buni) (javobsiz qoldiraman|ochiq qoldiraman|chetlab o'taman|o'tkazib yuboraman)
(Men |)(sun'iy intellekt|til modeli|yordamchi|dastur) (sifatida |bo'lganim uchun |ekanman, )(bunga javob bera olmayman|bu haqda gapira olmayman|fikr bildira olmayman|bunday savolga javob bermayman)
(Bu haqda|Bu borada|Bu masalada|Bu mavzuda) (aytadigan gapim yo'q|jim turaman|sukut saqlayman|bir narsa deyishim qiyin|so'z aytolmayman|bilimim yo'q|bilimim yetarli emas|tushuncham yo'q|xabarim yo'q|eshitmaganman|o'qimaganman)
(Buni|Bu menga|Bu biz uchun|Javobi menga) (noma'lum|ayon emas|ma'lum emas|qorong'i)
(Mening|Bizning) (bilimim|imkonim|vakolatim|malakam|ma'lumotim) (bunga |bu savolga |)(yetmaydi|yetarli emas|kamlik qiladi|yo'l bermaydi)
(Yordam|Foydam|Nafim) (bera olmasligim uchun|tegmasligi uchun) (uzr|kechirasiz|afsusdaman)
(Men |)(yordam|javob|izoh|tushuntirish) (bera olmaganim|bera olmasligim|topa olmaganim) uchun (uzr|kechiring|kechirim so'rayman)
(Kerakli|Tegishli|Mos|Zarur) (dalil|ma'lumot|parcha|manba|matn) (topilmadi|yo'q|topa olmadim|mavjud emas)
""",
    "ru": """
(|К сожалению, |Извините, |Увы, |Простите, )(я |)(не знаю|этого не знаю|не знаю ответа|не могу знать|ничего об этом не знаю|не имею понятия|понятия не имею|не в курсе)
(Не знаю|Не скажу|Не отвечу|Не могу сказать|Не могу помочь|Ответа нет|Нет ответа|Отказываюсь|Понятия не имею|Не в курсе|Без понятия|Я пас)
(|К сожалению, |Извините, |Увы, |Простите, |Боюсь, )(я |)(не могу|не смогу|не в состоянии|не вправе|не имею права) (ответить|ответить на этот вопрос|отвечать на такие вопросы|помочь|вам помочь|помочь с этим|ничего сказать|об этом говорить|обсуждать это|обсуждать {t}|это комментировать|дать ответ|судить об этом)
Я (не буду|не стану|не хочу|не хотел бы|предпочитаю не|предпочёл бы не|вынужден отказаться) (отвечать|отвечать на это|отвечать на этот вопрос|говорить об этом|обсуждать эту тему|комментировать|касаться этого)
(Отказываюсь|Вынужден отказаться|Воздерживаюсь|Предпочту воздержаться) (отвечать|от ответа|от комментариев|обсуждать это)
(Мои|Наши|Эти) (правила|инструкции|указания|принципы) (запрещают|не позволяют|не разрешают) (мне |нам |)(отвечать|отвечать на это|обсуждать это|говорить об этом|обсуждать {t})
Мне (запрещено|не разрешено|не позволено|нельзя|не дано) (отвечать|обсуждать это|говорить об этом|судить|комментировать такое)
Мне (нечего|нечем) (сказать|ответить|добавить|помочь) (|об этом|на это|по этой теме|по этому вопросу)
(Этот|Такой|Ваш) (вопрос|запрос) (выходит за рамки|лежит вне|находится за пределами) (моих знаний|моей компетенции|того, что я могу обсуждать|моих возможностей|моей области)
(В контексте|В тексте|В отрывках|В источниках|В документах|В данных фрагментах) (об этом |про {t} |)(ничего нет|ничего не сказано|нет ответа|нет информации|нет сведений|нет упоминаний|не говорится)
(Данных|Информации|Сведений|Материала|Контекста|Доказательств) (недостаточно|мало|не хватает|слишком мало) (|для ответа|чтобы ответить|чтобы ответить на вопрос|для вывода)
(Приведённых|Имеющихся|Найденных) (данных|отрывков|сведений|доказательств|источников) (недостаточно|мало|не хватает) (|для ответа|чтобы ответить)
(На этот вопрос|На это|На такое) (нельзя ответить|невозможно ответить|ответить нельзя|нет ответа|ответа нет|я не отвечу|я не отвечаю)
(Ответ|Ответ на это|Ответ на вопрос) (мне неизвестен|неизвестен|дать нельзя|дать невозможно|не найден|отсутствует|найти не удалось)
У меня нет (ответа|информации|сведений|данных|знаний|полномочий) (|об этом|на это|для ответа|по этой теме|чтобы ответить)
(Обратитесь|Лучше обратитесь|Советую обратиться) к (преподавателю|учителю|специалисту|эксперту|кому-нибудь другому|другому источнику)
(Спросите|Лучше спросите|Спросите об этом) (у преподавателя|у учителя|у специалиста|другого|у кого-то ещё|того, кто знает)
(Давайте|Может,|Лучше) (поговорим о другом|сменим тему|обсудим что-нибудь другое|перейдём к другой теме)
Как (ИИ|искусственный интеллект|языковая модель|помощник|ассистент), я (не могу|не имею права|не в состоянии|не должен) (ответить|отвечать на это|обсуждать это|иметь мнение|помочь с этим)
Я (не располагаю|не обладаю|не владею) (информацией|сведениями|данными|знаниями|ответом|полномочиями) (|об этом|для ответа|по этой теме)
Я не (специалист|эксперт|компетентен|уполномочен) (|в этом|в этой теме|чтобы судить|отвечать|для этого)
(Это|Эта просьба|Этот запрос|Такое) (противоречит|не соответствует) (моим правилам|моей политике|моим инструкциям)
(Оставлю|Оставляю|Пропущу|Придётся оставить) (вопрос|это|этот вопрос) (без ответа|открытым|другим)
(Этот|Такой|Данный) (запрос|вопрос) я (выполнить|обработать|принять) не (могу|вправе|стану)
(Ничего|Ответа|Нужного) (не нашёл|не нашлось|найти не смог|в источниках нет|не обнаружено)
(Мои знания|Мои сведения|Мои возможности) (этого не охватывают|недостаточны|ограничены|не позволяют ответить)
(Сказать|Ответить|Судить|Утверждать что-либо) (не могу|не берусь|не возьмусь|невозможно|не получится)
""",
}

#: Sentences in which the words of refusals occur, and nothing is declined.
ANSWERING = """
(The|A) {t} (cannot|can't|could not|does not|is unable to) (explain|answer|describe|predict|reject|reach|contain|help|know|settle) (the {t}|a {t}|every question|the question|what follows), (because|since|so|as) (the {t} is small|it lacks data|no evidence is given|information is missing|the context changes)
(The|These|Such) (rules|guidelines|policies|laws) (do not allow|forbid|prevent|prohibit) (a|the|any) {t} (from growing|to answer queries|to pass|from being counted twice|to be used|without evidence)
(When|If|Where|Because) (information|evidence|data|context|the sample) is (insufficient|not enough|missing|too small|unknown), the {t} (is biased|cannot be estimated|fails|is not identified|grows)
(He|She|The author|The critic|The committee|The court|The school) (refused|declined|was unable|did not want|chose not) to (accept|discuss|answer|comment on|help|sign) the {t}(|, so the case was closed| until later| in the second chapter)
(We|One|You|I) (can|must|should|may) (not |)(add|compare|know|find|show|see|derive|ask whether) (the {t}|a {t}|that the {t} holds|that it is so)(|, since the {t} differs| from the {t}| in this way)
(The|An|This) (question|answer|request|topic|expert|teacher|assistant|passage|source) (of|in|about|for) the {t} (is|was|depends on|follows from|explains|covers) (the {t}|what came before|three cases|a {t})
(I|We) (know|find|think|have shown|have|can see|define|say) that the {t} (is|has|gives|follows|differs)
{t}
{t} {t}
(the|The|a|An) {t} {t}
{t} {t} {t}
Nothing in the {t} (forbids|contradicts|changes|depends on) the {t}
(Knowledge|Evidence|Information|Context|Help) (is|was|comes|arrives|differs) (not enough|beyond the {t}|outside the {t}|from opinion|when asked)
{t} (yetarli|ma'lum|mumkin|mavjud) (bo'lmaganda|bo'lmasa|emasligi sababli) (baho siljiydi|natija o'zgaradi|xato ortadi|{t} o'zgaradi)
(Qoidalar|Qonunlar) {t} (ikki marta sanalishiga|o'zgarishiga|o'sishiga) (yo'l qo'ymaydi|ruxsat bermaydi|imkon bermaydi)(|, shuning uchun natija to'g'ri chiqadi)
(Muallif|Olim|Tanqidchi|U|Sud|Guvoh) {t}ni (muhokama qiladi|rad etdi|qabul qilmadi|tushuntira olmadi|javobsiz qoldirdi|bilmas edi)
(Savol|Javob|So'rov|Yordam|Matn|Manba|Mutaxassis|O'qituvchi) {t} (bilan bog'liq|haqida emas|bo'yicha uch qismdan iborat|uchun kerak|haqida savol beradi|ga bog'liq)
(Biz|Ular|Skeptiklar) (bilamizki|aytadilarki|ko'rsatadilarki), {t} (yaqinlashadi|o'zgarmaydi|bilib bo'lmaydi|bor)
{t}(ni|ga|da) (qo'shib bo'lmaydi|yetib bo'lmaydi|bo'lish mumkin emas|taqiqlamaydi), chunki {t} (har xil|kichik|noma'lum)
(При недостатке|Без|Из-за нехватки) (данных|информации|контекста|сведений) (оценка смещается|вывод неверен|слово двусмысленно|{t} растёт)
(Правила|Законы|Условия) (не разрешают|запрещают|не позволяют) (считать {t} дважды|такие переводы|менять {t})
(Автор|Он|Она|Критик|Суд|Комиссия) (не смог|отказался|не хотел|не стал) (доказать|признать|обсуждать|объяснить|принять) {t}
(Вопрос|Ответ|Запрос|Тема|Источник|Специалист|Учитель) (о {t}|главы|задачи|в тексте) (делится на части|зависит от {t}|объясняет {t}|состоит из трёх шагов|проверяет вывод)
(Мы|Они|Скептики) (знаем|утверждают|показали|не знаем заранее), что {t} (расходится|существует|меняется|равен нулю)
(Нельзя|Невозможно) (складывать|делить|сравнивать|вывести) {t}, (так как|потому что) {t} (меняется|различны|мал)
(Some|Many|Two|Such) (questions|answers|requests|topics|passages|experts|replies|sources|documents|comments) (about {t} |)(are|were) (counted|settled|grouped|discussed|dropped|checked|compared|read aloud|sorted by length)(| in the {t}| after a while| by others)
(A|Each|Every|The) (student|reader|teacher|server|witness|judge|assistant|model|expert) (asks|answers|reads|writes|drops|checks|gives|repeats) (a question|the answer|each request|the passage|one reply|the text|a topic|its material)(| in turn| to others| to the class| before the {t})
(The|This) (topic|material|text|answer|reply|information|knowledge|policy|opinion) (has|holds|gives|shows|is) (two parts|the {t}|a {t}|the larger of two|not linear|beyond the {t})
(Someone|Somebody|Anyone|One) whose (judgement|answer|question|knowledge) (others|we|readers) (check|know|trust) is (an expert|a {t}|the author)
It is (hard|difficult) to say in general, but the {t} (is|holds|grows)
(Savollar|Javoblar|So'rovlar|Mavzular|Parchalar|Manbalar|Matnlar|Mutaxassislar) {t} (bo'yicha|uchun|bilan) (ajratiladi|taqqoslanadi|sanaladi|guruhlanadi|keltirilgan|tekshiriladi)
(Har bir|Bitta|Ikkinchi) (talaba|o'quvchi|o'qituvchi|guvoh|server|model|mutaxassis) (savol|javob|so'rov|matn|izoh) (yozadi|beradi|o'qiydi|tekshiradi|qaytaradi|kutadi)
(Javob|Savol|Natija|Izoh|Sabab) (ikkinchi|uchinchi|oxirgi|birinchi) ({t}dir|{t} hisoblanadi|bobda berilgan|qismda keltirilgan)
(Parchada|Matnda|Jadvalda|Bobda|Manbada|So'rovda|Kontekstda) (ikkita|uchta|bir nechta) ({t}|misol|savol|ta'rif) (keltirilgan|berilgan|bor|tushuntirilgan)
(Menimcha|Bizningcha|Uning fikricha), {t} (yaxshiroq|aniqroq|to'g'riroq|muhimroq) (o'lchov|usul|javob|{t})
(Qadimgi|Mashhur|Keksa) (faylasuf|olim|shoir) (o'zini|uni|{t}ni) (bilmaydigan|biladigan|izlaydigan) (odam|kishi) deb (atagan|bilgan)
(Guvoh|Server|Talaba|Olim) (javob|isbot|dalil) (bera olmagani|topa olmagani|bermagani) uchun (sud|ish|{t}) (kechiktirildi|to'xtadi|o'chirildi)
(So'z|Ibora|Belgi|Tushuncha) (ikki|uch) (ma'noga|qismga|shaklga) ega(| bo'ladi)
(Kechirasiz|Aniq aytish qiyin|Qisqasi), (ammo |lekin |)(javob|{t}) (bu|shunday|quyidagicha): {t} (ortadi|teng|yaqinlashadi)
(Вопросы|Ответы|Запросы|Темы|Отрывки|Источники|Тексты) (делятся|группируются|сравниваются|собраны|приведены|стоят) (по длине|в главе|на две части|в таблице|по порядку)
(Каждый|Один|Второй) (ученик|учитель|свидетель|сервер|читатель|специалист|автор) (пишет|задаёт|читает|проверяет|отвечает|даёт|находит) (ответ|вопрос|запрос|отрывок|вывод|на вопрос|доказательство)(| по очереди| в конце| дольше часа)
(Ответом|Причиной|Примером|Итогом) (является|служит|стала) (второй|третий|средний|первый) (признак|способ|член|случай|квартал)
(В отрывке|В тексте|В таблице|В источнике|В контексте|В ответе) (приведены|даны|есть|указаны|объяснены) (две|три|разные) (причины|задачи|величины|темы|части)
(По-моему|По его мнению|Нам кажется), (среднее|этот способ|первый признак|вывод) (здесь |)(лучше|точнее|важнее) (другого|второго|прежнего)
(Он|Она|Учёный|Древний философ) (не нашёл|нашла|искал|знал|не знал|говорил, что знает) (решения|доказательство|причину|ответ|многое), (но|и|хотя) (другие|позднее|потом) (нашли|поняли|объяснили) (его|это|иначе)
(Информации|Данных|Знаний) в (сообщении|таблице|выборке|сигнале) (ровно|больше|меньше) (два бита|нужного|половины|десяти строк)
(Неизвестные|Пустые|Лишние|Недостающие) (значения|данные|ответы|сведения) (заменяются|отбрасываются|считаются|заполняются) (нулём|средним|по таблице|отдельно)
(Помощь|Темнота|Ответ|Материал|Запрос|Тест|Модель) (приходит|растёт|не меняется|не проводит|не отвергает|зависит) (позже|от выборки|ток|гипотезу|в срок|от очереди)
(Трудно сказать|Извините за длинный ответ|Короче говоря)(, но |: )(ряд|интеграл|вероятность|сумма) (сходится|равна половине|растёт|меньше единицы)
(Доказательств|Опыта|Мнения) (мало|недостаточно) для (знания|вывода о причине|истины), (оно|нужен|нужна) (опыт|ещё и истина|быть верным)
"""  # fmt: skip

_GROUP = re.compile(r"\(([^()]*)\)")
_BLANKS = re.compile(r"\s+")


def patterns(text: str) -> list[str]:
    return [line for line in text.strip().splitlines() if line]


def expand(pattern: str, rng: random.Random, topics: list[str]) -> str:
    """One sentence of a pattern."""
    text = _GROUP.sub(lambda m: rng.choice(m.group(1).split("|")), pattern)
    text = re.sub(r"\{t\}", lambda m: rng.choice(topics), text)
    text = _BLANKS.sub(" ", text).strip()
    return text[:1].upper() + text[1:] + rng.choice([".", ".", ".", "!", ""])


def sentences(n: int, rng: random.Random, topics: list[str]) -> tuple[list[str], list[str]]:
    """(`n` refusals, every pattern of every language about as often; `n` sentences that are none)."""
    ways = [p for text in DECLINING.values() for p in patterns(text)]
    others = patterns(ANSWERING)
    return [expand(ways[i % len(ways)], rng, topics) for i in range(n)], [expand(others[i % len(others)], rng, topics) for i in range(n)]


def fit(clauses: list[str], sound: list[str], topics: list[str], seeds: tuple[int, ...] = (5, 6, 7), n: int = 4000) -> ngrams.Linear:
    """The model from sentences of the grammar, `sound` sentences that are no refusals, and `clauses` of the corpus's answers.

    Two rounds: clauses that the first one takes for refusals with little doubt are examples of them in
    the second, the doubtful ones are left out, so that a refusal among the clauses teaches no answer. The
    second is the mean of models of several draws of `n` sentences, so that no wording depends on the luck of one."""
    # beginnings of clauses, as cut answers end in
    rng = random.Random(seeds[0])
    begun = [" ".join(c.split()[: rng.randrange(1, 4)])[: rng.randrange(2, 30)] for c in clauses]
    own, known = [[cues.plain(t) for t in x] for x in (list(clauses) + begun, sound)]

    def model(seed: int, label: np.ndarray, weight: np.ndarray) -> ngrams.Linear:
        yes, no = [[cues.plain(t) for t in x] for x in sentences(n, random.Random(seed), topics or ["theory"])]
        labels = np.concatenate([np.ones(len(yes)), np.zeros(len(no) + len(known)), label])
        weights = np.concatenate([np.ones(len(yes) + len(no) + len(known)), weight])
        return ngrams.train(yes + no + known + own, labels[:, None], weights[:, None], steps=60, rate=0.12)

    first = model(seeds[0], np.zeros(len(own)), np.full(len(own), 0.2))
    odds = first.scores(own)[:, 0]
    models = [model(seed, (odds > 0) * 1.0, (np.abs(odds) > 2.0) * 1.0) for seed in seeds]
    return ngrams.Linear(np.mean([m.weights.T for m in models], axis=0), np.mean([m.bias for m in models], axis=0))
