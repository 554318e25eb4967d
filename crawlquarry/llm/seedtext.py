"""A few sentences of our own for each language: the clean text from which the character model is trained."""

SEEDS: dict[str, str] = {
    "en": "The garden opens at nine o’clock – “please wait” at the gate… It costs £5 or €6, about 20 °C outside. Café and naïve are loan words. See § 12 and the © notice; ± 3 % is fine. 👍 ❤️ Good morning!",
    "de": "Die Straße führt über den Fluß und für Fußgänger ist der Weg gesperrt. Häufig müssen Gäste früh prüfen, ob die Tür geöffnet ist. Änderungen und Übungen fürs Büro gehören außerdem in die Größe der Mappe. Nächtliche Züge fahren nördlich. Während der März wächst, täglich schön. Zuständige Behörde: Verfügung über Zugänge, Löschung und Schlüssel. Öffnungszeiten für Kühlräume. Überall möglich.",
    "fr": "Les élèves étaient déjà arrivés à l’école où les fenêtres étaient fermées. L'été, le musée général reste fermé après minuit. Accès limité à la catégorie archivée; règles à répéter. Où êtes-vous né? Français, garçon, leçon, reçu. Cœur, sœur, naïf, maïs. Le répertoire précédent est déplacé. Être prêt, rêve, crème, père, très bientôt, goût, août, hôtel. «Voilà», dit-elle. Générées, créée, désolé, vérifié, délai, numéro.",
    "es": "El niño y la señora caminan por la montaña en otoño. Mañana habrá más sección y construcción de la página rápida. Ningún catálogo está aquí; ¿dónde está? ¡Qué fácil! Añadir, leerá, según, después, también, año, años, español, público, número, único, útil, línea, código, búsqueda, versión, pingüino.",
    "pt": "A atualização da seção não é rápida; as maçãs e o pão estão às cinco horas. Atenção: são páginas de coração. Você não está só. Ações, opções, lições, irmãos, mães, canções, também, até, três, português, catálogo, máquina, órgão, útil, você, avó, avô. NÃO É PERMITIDO. ATENÇÃO, SÃO PÁGINAS, AÇÃO.",
    "it": "Perché la città è così bella? Però non c'è più caffè. Lunedì andrò lì, già, può, virtù, qualità, università, È vero.",
    "nl": "Een coördinatie in België: geïnteresseerd, één, reünie, crème.",
    "sv": "Sökvägen är öppen för alla som går på vägen. Vår server är långsam och försiktig. Små öar, gård, hår, år, även, nästa, många, två, också, åtta, öst. Ångström, Åsa, Öppna, Ändra.",
    "da": "Smør og brød på øen. Blåbær, rød grød med fløde, også går vi på gåtur. Æble, Østersø, København, måske, færge, så, får, når. Først bør næste være lært.",
    "pl": "Proszę nie pobierać źródeł; część stron jest już zamknięta. Łączny rozmiar to sześć tysięcy wpisów. Żółta łódź płynie później przez Łódź. Spróbuj, niedostępna, gęś, mąż, książka, dźwięk, świat, chłopiec, dzień, koń, wąż, być, mieć, ćwiczenie, należy, także, można, wyłącz, źródła, które, więc, się, są, tę, może.",
    "cs": "Prosíme, nečtěte složku příliš často. Žádné změny před úterým, řádek. Příliš žluťoučký kůň úpěl ďábelské ódy. Přístup, složky, žádný, příklad, můžete, někdy, další, během, děti, těžký, šťastný, čtvrtek, že, již, více, který, při, včera, dům, stůl, České, Říjen, Šest, úřad, příští. Žlutá, zpět, měsíc, řeka, říká, později, vyhledávání, nesmí, číst, stránek, před, ještě.",
    "sk": "Prečo ľudia čítajú stránky každý deň? Žiadny prístup, ďakujem, môže, vôbec, ktorý, ešte, päť, účet, šťastie, kôň, vŕba, stĺp, mäso, neskôr, skúste.",
    "hu": "Az időjárás szép, de később eső lesz. Kérjük, próbálja újra: őszi gyümölcs, tűz, fűző, művész, öröm, kettő, árvíztűrő tükörfúrógép. Működik, nyitó, közösség, szükséges, különböző, Üdvözlet.",
    "ro": "Vă rugăm să nu citiți această pagină înainte de ora șase. Țara, știință, pădure, în, și, când, după, către, însă, română, fără, apă.",
    "tr": "Lütfen bu sayfayı daha sonra açın. Güneş doğdu, çocuk okula gitti. İstanbul, ığdır, şeker, öğrenci, müdür, değil, kapalı, için, çalışma, güncel, başka, dün.",
    "el": "Οι κανόνες αλλάζουν κάθε μήνα. Μην διαβάζετε τον φάκελο. Το αρχείο είναι κλειστό και η σελίδα δεν υπάρχει πια. Καλημέρα, πώς είστε σήμερα; Ο κόσμος της θάλασσας, η χώρα, το νησί, ένα παιδί, η ώρα. Όλα τα έγγραφα, αυτό, αυτή, πολύ, μεγάλο, μικρός, άνθρωπος, νέα, αράχνη, ρομπότ, αναζήτηση, ιστοσελίδα, παρακαλώ, χρήστης. Προσοχή, Ελλάδα, Αθήνα, Ιούνιος.",
    "ru": "Не обходите этот раздел чаще раза в час. Правила обновлены, старые страницы закрыты. Копия каталога для архива. Сегодня хорошая погода, и дети играют во дворе. Пожалуйста, подождите, сервер временно недоступен. Поиск по сайту, новости, помощь, проверка, ошибка доступа, пользователь, файлы, данные, время, человек, работа, дело, город, жизнь, рука, день, каждый, который, только, очень, можно, когда, после, перед, между, паук, робот, индекс, запрещено, разрешено, вход, выход. Москва, Россия, Объявление, Ещё, Это, Для, При, Все.",
    "uk": "Будь ласка, зачекайте: сторінка тимчасово недоступна. Україна, її, ґанок, єдність, інформація, пошук, новини, дозволено, заборонено.",
    "bg": "Моля, не четете тази страница твърде често. Търсене, правила, обновяване, файлове.",
    "ja": "更新は毎週火曜日です。このページは索引に入れないでください。検索エンジンの利用者は、明日もう一度お試しください。データとサーバーについて、ご注意ください。日本語の文章には、ひらがなとカタカナと漢字があります。東京、大阪、京都。ファイルをダウンロードする。ありがとうございます。",
    "zh": "请不要抓取这个目录。网站正在更新,请稍后再试。中国的城市很大,人们每天都在工作。搜索引擎可以访问首页。蜘蛛、机器人、新闻、数据、服务器。",
    "ko": "이 페이지는 색인하지 마십시오. 서버 점검 중입니다. 안녕하세요, 오늘은 날씨가 좋습니다. 검색 로봇.",
    "fa": "این صفحه‌ها را نمی‌خواهیم. پوشه‌های بسته است. لطفاً دوباره تلاش کنید. سلام، امروز هوا خوب است.",
    "ar": "يرجى عدم زيارة هذه الصفحة. الموقع مغلق اليوم. السلام عليكم، البحث في الأرشيف متاح للجميع.",
    "he": "נא לא לסרוק את הדף הזה. האתר סגור היום, שלום לכולם.",
    "lt": "Šis žemėlapis rodo visus kelius į ežerą ir mišką. Prašome neįeiti į sodą po vidurnakčio; įėjimas uždarytas. Ąžuolas, ėjimas, žalia, šviesa, mūsų, jūsų, būti, ačiū, daržų taisyklės.",
    "lv": "Šeit ir ceļš uz ezeru, bet dārza vārti ir slēgti. Lūdzu, nāciet vēlāk; kāpēc mēs gaidām šķūnī? Zeme, ūdens, māja, ģimene, ļoti, skaņa.",
    "vi": "Khu vườn mở cửa lúc chín giờ, xin vui lòng chờ ở cổng. Đường đến hồ nước rất đẹp và mọi người được phép đi bộ. Những thay đổi của trang này đã được ghi lại.",
    "th": "สวนเปิดเวลาเก้าโมงเช้า กรุณารอที่ประตู ทางไปทะเลสาบปิดแล้ว ข้อมูลของหน้านี้เปลี่ยนแปลงทุกวัน ห้ามเข้าโดยไม่ได้รับอนุญาต",
    "zh-tw": "花園早上九點開門，請在門口等候。這個頁面的內容每天都會更新，測試與資料請勿轉載。中文說明，開放時間，歡迎光臨。",
}
