"""Labelled phrases the residue models start from, by kind; one per line.

General knowledge of the web: the messages of well-known servers and frameworks, the filler of page
builders and the placeholder syntaxes of template languages, in seven languages. None was taken
from the texts that are searched; how these put it is learnt from them (see ``residue.fit_corpus``).
"""

FILLER = """
lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua
ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat
duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur
excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum
nullam vestibulum pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas
curabitur blandit tempus porttitor. vivamus sagittis lacus vel augue laoreet rutrum faucibus dolor auctor. maecenas faucibus mollis interdum
aenean lacinia bibendum nulla sed consectetur. cras mattis consectetur purus sit amet fermentum. integer posuere erat a ante venenatis
your text here. your title here. your name here. your headline here. your content here. your description here. your image here.
insert text here. enter text here. type your text here. add your text here. put your text here. place your content here. write your text here.
this is a sample text. this is just a placeholder. this is dummy text. placeholder text. sample text. dummy text. filler text. example text.
this text will be replaced. replace this text with your own. replace this with your own content. to be replaced. to be written. to be filled in later.
click here to edit this text. double click here to edit. click to add text. click to add title. edit this paragraph. edit me.
use this space to tell people about your business. tell your visitors something about you. describe your service here. describe what you offer here.
add a description here. add a caption here. add a short text here. insert a heading here. heading goes here. caption goes here. content coming soon.
todo: add text. todo: write content. tbd. text to follow. copy to come. content to be added. image caption here. quick brown fox jumps over the lazy dog.
test test test test. asdf asdf asdf asdf. xxx xxx xxx xxx. bla bla bla bla. foo bar baz qux. abc abc abc.
hier steht ihr text. hier kommt der text hin. fügen sie hier ihren text ein. geben sie hier ihren text ein. ihr titel hier. ihre überschrift.
dies ist ein beispieltext. das ist ein platzhalter. platzhaltertext. mustertext. blindtext. dieser text wird später ersetzt. text folgt. inhalt folgt in kürze.
klicken sie hier, um den text zu bearbeiten. beschreiben sie hier ihr angebot. bitte durch eigenen text ersetzen. überschrift einfügen. titel einfügen.
votre texte ici. saisissez votre texte ici. insérez votre texte ici. ajoutez votre titre ici. votre contenu ici. titre à insérer ici.
ceci est un exemple de texte. ceci est un texte de remplissage. texte d'exemple. texte provisoire. ce texte sera remplacé. texte à venir. remplacez ce texte.
cliquez ici pour modifier ce texte. décrivez ici votre activité. à remplacer par votre contenu. faux texte. légende de l'image.
su texto aquí. escriba su texto aquí. inserte aquí su texto. añada aquí el título. su contenido va aquí. escribe aquí tu texto. introduzca el título.
este es un texto de ejemplo. esto es un texto de relleno. texto de ejemplo. texto provisional. este texto será reemplazado. sustituya este texto. próximamente contenido.
haga clic aquí para editar este texto. describa aquí su empresa. pie de foto. texto simulado.
tutaj wpisz tekst. wpisz swój tekst tutaj. wstaw tekst tutaj. dodaj tutaj tytuł. tutaj pojawi się treść. wprowadź tytuł.
to jest przykładowy tekst. to jest tekst zastępczy. przykładowy tekst. tekst do zastąpienia. ten tekst zostanie zastąpiony. zamień ten tekst na własny. treść wkrótce.
kliknij tutaj, aby edytować tekst. opisz tutaj swoją firmę. podpis pod zdjęciem.
введите текст здесь. вставьте текст сюда. ваш текст здесь. добавьте заголовок. здесь будет текст. здесь появится описание. введите заголовок.
это пример текста. это образец текста. это текст-заполнитель. пример текста. текст будет заменён. замените этот текст своим. содержание появится позже. рыбный текст.
нажмите, чтобы изменить текст. опишите здесь вашу компанию. подпись к картинке.
ここにテキストを入力してください。ここにタイトルを入力。ここに本文が入ります。ここに説明文を入れてください。見出しが入ります。
これはサンプルテキストです。ダミーテキストです。サンプル文章。この文章はダミーです。テキストを差し替えてください。仮のテキストです。準備中です。
クリックしてテキストを編集してください。画像の説明が入ります。
"""

ERROR = """
404 not found. the requested url was not found on this server. 404 error. error 404. page not found. file not found. object not found. resource not found.
the page you requested could not be found. the page you are looking for does not exist. sorry, we couldn't find that page. oops! that page can't be found.
the page you were looking for has been moved, renamed or removed. this page is no longer available. this content has been deleted. nothing was found at this location.
the link may be broken or the address may have been typed incorrectly. please check the url and try again. the link you clicked is broken or out of date. we can't find what you are looking for.
403 forbidden. you don't have permission to access this resource. access denied. access is denied due to invalid credentials. you are not authorized to view this page. your request was blocked.
401 unauthorized. authentication required. 400 bad request. your browser sent a request that this server could not understand. 405 method not allowed. 410 gone. the requested resource is gone.
500 internal server error. the server encountered an internal error or misconfiguration and was unable to complete your request. application error. a server error occurred. unhandled exception.
502 bad gateway. 503 service unavailable. 504 gateway timeout. the server is temporarily unable to service your request due to maintenance downtime or capacity problems. please try again later.
the upstream server did not respond in time. the request timed out. connection timed out. the server took too long to respond. the host is unreachable. unable to connect to the server.
error establishing a database connection. could not connect to the database. database error. fatal error: uncaught exception. stack trace. warning: undefined variable on line 0. call to undefined function.
something went wrong. an error occurred. an unexpected error has occurred while processing your request. we are sorry, an error has occurred. please try again in a few minutes. we are working to fix the problem.
your session has expired. please log in again. your session timed out due to inactivity. you have been logged out. please sign in to continue. invalid or expired token.
429 too many requests. you have exceeded the rate limit. please slow down. the service is overloaded. the site is down for maintenance. we will be back soon. this account has been suspended. this site is currently unavailable.
error code: 0. request id: 0. reference number 0. if the problem persists, contact the site administrator. report this problem. quote this number to support. go back to the home page. return to the previous page.
seite nicht gefunden. die angeforderte seite wurde nicht gefunden. die gesuchte seite existiert nicht oder wurde verschoben. datei nicht gefunden. diese seite ist nicht mehr verfügbar. der link ist veraltet oder fehlerhaft.
zugriff verweigert. zugriff nicht gestattet. sie haben keine berechtigung, diese seite aufzurufen. interner serverfehler. dienst nicht verfügbar. der server ist vorübergehend nicht erreichbar. bitte versuchen sie es später erneut.
es ist ein fehler aufgetreten. ein unerwarteter fehler ist aufgetreten. etwas ist schiefgelaufen. ihre anfrage konnte nicht verarbeitet werden. ihre sitzung ist abgelaufen. bitte melden sie sich erneut an. zeitüberschreitung. verbindung fehlgeschlagen.
die datenbankverbindung konnte nicht hergestellt werden. wartungsarbeiten. wenden sie sich an den administrator. fehlercode 0. zurück zur startseite.
page introuvable. la page demandée est introuvable. la page que vous recherchez n'existe pas ou a été déplacée. fichier non trouvé. cette page n'est plus disponible. le lien est rompu ou obsolète.
accès refusé. accès interdit. vous n'avez pas l'autorisation d'accéder à cette page. erreur interne du serveur. service indisponible. le serveur est temporairement indisponible. veuillez réessayer plus tard.
une erreur est survenue. une erreur inattendue s'est produite. votre demande n'a pas pu être traitée. votre session a expiré. veuillez vous reconnecter. délai d'attente dépassé. échec de la connexion. site en maintenance. retour à l'accueil.
página no encontrada. la página solicitada no existe. la página que busca no se encuentra o ha sido movida. archivo no encontrado. esta página ya no está disponible. el enlace está roto o es antiguo.
acceso denegado. acceso prohibido. no tiene permiso para acceder a esta página. error interno del servidor. servicio no disponible. el servidor no está disponible temporalmente. inténtelo de nuevo más tarde.
se ha producido un error. ha ocurrido un error inesperado. algo salió mal. no se pudo procesar su solicitud. su sesión ha caducado. vuelva a iniciar sesión. tiempo de espera agotado. error de conexión. sitio en mantenimiento. volver al inicio.
nie znaleziono strony. strona nie została znaleziona. strona, której szukasz, nie istnieje lub została przeniesiona. nie znaleziono pliku. ta strona nie jest już dostępna. odnośnik jest nieaktualny lub uszkodzony.
odmowa dostępu. dostęp zabroniony. nie masz uprawnień do wyświetlenia tej strony. wewnętrzny błąd serwera. usługa niedostępna. serwer jest chwilowo niedostępny. spróbuj ponownie później.
wystąpił błąd. wystąpił nieoczekiwany błąd. coś poszło nie tak. nie udało się przetworzyć żądania. twoja sesja wygasła. zaloguj się ponownie. przekroczono limit czasu. błąd połączenia. przerwa techniczna. wróć do strony głównej.
страница не найдена. запрошенная страница не найдена. страница, которую вы ищете, не существует или была перемещена. файл не найден. эта страница больше не доступна. ссылка устарела или повреждена.
доступ запрещён. доступ закрыт. у вас нет прав для просмотра этой страницы. внутренняя ошибка сервера. сервис недоступен. сервер временно недоступен. повторите попытку позже.
произошла ошибка. произошла непредвиденная ошибка. что-то пошло не так. не удалось обработать запрос. ваша сессия истекла. войдите снова. время ожидания истекло. ошибка соединения. технические работы. вернуться на главную.
ページが見つかりません。お探しのページは見つかりませんでした。ページは存在しないか、移動または削除された可能性があります。ファイルが見つかりません。このページは公開を終了しました。リンクが切れています。
アクセスが拒否されました。アクセス権限がありません。内部サーバーエラー。サービスを利用できません。サーバーに一時的に接続できません。しばらくしてからもう一度お試しください。
エラーが発生しました。予期しないエラーが発生しました。リクエストを処理できませんでした。セッションの有効期限が切れました。もう一度ログインしてください。タイムアウトしました。メンテナンス中です。トップページへ戻る。
"""

SCRIPT = """
please enable javascript to view this page. please enable javascript in your browser. please turn on javascript and reload the page. you must have javascript enabled to use this site.
you need to enable javascript to run this app. we're sorry but this app doesn't work properly without javascript enabled. this site requires javascript. this page needs javascript to work.
javascript is disabled in your browser. javascript is required. javascript is not enabled. javascript must be enabled in order for you to use this page. your browser does not support javascript. it looks like javascript is turned off.
enable javascript and cookies to continue. checking your browser before you access the site. turn on scripts in your browser settings. allow scripts to run and refresh this page. scripts are blocked. content could not be loaded without scripts.
without javascript parts of this site will not work. to see this content, switch on javascript. instructions how to enable javascript in your web browser. this application needs scripting. loading, please wait.
bitte aktivieren sie javascript. javascript ist deaktiviert. diese seite benötigt javascript. um diese seite zu nutzen, muss javascript aktiviert sein. ihr browser unterstützt kein javascript. ohne javascript funktioniert diese anwendung nicht. skripte erlauben und seite neu laden.
veuillez activer javascript. javascript est désactivé dans votre navigateur. ce site nécessite javascript. pour afficher cette page, activez javascript. votre navigateur ne prend pas en charge javascript. autorisez les scripts et rechargez la page.
active javascript para ver esta página. javascript está desactivado en su navegador. este sitio requiere javascript. debe habilitar javascript para continuar. su navegador no admite javascript. permita los scripts y recargue la página.
włącz javascript, aby wyświetlić stronę. javascript jest wyłączony w twojej przeglądarce. ta strona wymaga javascript. aby korzystać z serwisu, włącz obsługę javascript. twoja przeglądarka nie obsługuje javascript. zezwól na skrypty i odśwież stronę.
включите javascript, чтобы просмотреть страницу. javascript отключён в вашем браузере. для работы сайта требуется javascript. ваш браузер не поддерживает javascript. разрешите выполнение скриптов и обновите страницу.
javascriptを有効にしてください。javascriptが無効になっています。このページを表示するにはjavascriptが必要です。お使いのブラウザはjavascriptに対応していません。スクリプトを許可して再読み込みしてください。
"""

CHROME = """
home. about us. contact. products. services. news. blog. shop. search. login. sign in. register. my account. cart. help. faq. sitemap. categories. menu. skip to content. toggle navigation. read more. share. print. next. previous. subscribe to our newsletter. follow us
we use cookies to improve your experience on our website. by continuing to browse you agree to our use of cookies. accept all cookies. reject all. cookie settings. manage preferences. this website uses cookies. cookie policy
copyright 0. all rights reserved. privacy policy. terms of use. terms and conditions. imprint. powered by. back to top. legal notice. accessibility. careers. press
startseite. über uns. kontakt. produkte. leistungen. aktuelles. suche. anmelden. warenkorb. hilfe. impressum. datenschutz. alle rechte vorbehalten. diese website verwendet cookies. alle akzeptieren. ablehnen. cookie-einstellungen. mehr erfahren. nach oben. agb. wir verwenden cookies, um ihr erlebnis zu verbessern
accueil. à propos. contact. produits. services. actualités. recherche. connexion. panier. aide. mentions légales. politique de confidentialité. tous droits réservés. ce site utilise des cookies. tout accepter. tout refuser. paramètres des cookies. plan du site. nous utilisons des cookies pour améliorer votre expérience
inicio. sobre nosotros. contacto. productos. servicios. noticias. buscar. iniciar sesión. carrito. ayuda. aviso legal. política de privacidad. todos los derechos reservados. este sitio utiliza cookies. aceptar todas. rechazar. configuración de cookies. mapa del sitio. utilizamos cookies para mejorar su experiencia
strona główna. o nas. kontakt. produkty. usługi. aktualności. szukaj. zaloguj się. koszyk. pomoc. polityka prywatności. wszelkie prawa zastrzeżone. ta strona używa plików cookie. akceptuj wszystkie. odrzuć. ustawienia plików cookie. regulamin. mapa strony
главная. о нас. контакты. товары. услуги. новости. поиск. войти. корзина. помощь. политика конфиденциальности. все права защищены. этот сайт использует файлы cookie. принять все. отклонить. настройки cookie. карта сайта. наверх
ホーム。会社概要。お問い合わせ。製品情報。サービス。ニュース。検索。ログイン。カート。ヘルプ。プライバシーポリシー。利用規約。サイトマップ。当サイトではcookieを使用しています。すべて同意する。拒否する。設定。無断転載を禁じます。ページの先頭へ
"""

TEMPLATE = """
hello {{ name }}, {{user.first_name}} {{ title | upper }} {{title|default}} {{{body}}} {{#if}} {{/if}} {{> header}} welcome to {{shop}}!
hello {name}, {user.name} {0} {1} {date}. from {city} to {city} for {price}! {$name} {$user.name} {@name} {#name} {:name}
hello ${name}, ${user.name} ${price} #{name} #{user.name} %(name)s %(count)d %{name} $(name) $name$ $NAME$ @name@ @{name}
<%= name %> <%=name%> <% name %> <?= $name ?> <name> <first_name> &lt;name&gt; &lt;first name&gt; {% name %} {%name%} {% include header %} {* name *}
[[name]] [[first_name]] [name] [first name] [insert name] [insert name here] [your name] [your company name here] [title here] [NAME] [FIRST NAME]
%name% %NAME% %FIRST_NAME% %%name%% %%NAME%% %%FIRST_NAME%% __name__ __NAME__ __FIRST_NAME__ ##name## ###NAME### ###FIRST_NAME### ||name|| *|NAME|* ~name~ ^name^
:name :name: :first_name: @Model.Name @Model.FirstName @ViewBag.Title «name» «first_name» ‹name› ⟦name⟧ &name; $colour$ $first_name$
dear undefined, welcome to undefined. [object Object] and [object Object] for only undefined. undefined [object Object] undefined undefined. hello undefined!
"""
