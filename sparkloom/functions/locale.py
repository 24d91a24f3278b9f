"""Locales and messages: lookup with fallback, as map literals that the optimizer folds."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import WS_PY, fill, is_filled, strip_py

DEFAULT = "en-US"
#: The supported locales, and where other tags go.
LOCALES = ("en-US", "zh-CN", "zh-TW", "zh-HK", "ja-JP", "ko-KR", "fr-FR", "de-DE", "es-ES", "it-IT", "vi-VN", "id-ID")
FALLBACKS = {
    "zh": "zh-CN", "zh-TW": "zh-TW", "zh-HK": "zh-HK", "en": "en-US", "ja": "ja-JP", "ko": "ko-KR",
    "fr": "fr-FR", "de": "de-DE", "es": "es-ES", "it": "it-IT", "vi": "vi-VN", "id": "id-ID",
}

#: Our own texts.  What a locale lacks comes from the default locale: ``msg_manual_enable_required`` in all others,
#: and de-DE's ``status_done``, whose English text the SQL of ``catalogue_lookup`` asks for.
MESSAGES: dict[str, dict[str, str]] = {
    "en-US": {
        "status_listing": "Reading the list of skills",
        "status_showing": "Reading the skill",
        "status_creating": "Saving the skill",
        "status_updating": "Changing the skill",
        "status_deleting": "Removing the skill",
        "status_done": "Finished",
        "status_list_done": "{count} skills, {active_count} of them active",
        "status_show_done": "Read {name}",
        "status_create_done": "Saved {name}",
        "status_create_overwrite_done": "Replaced {name}",
        "status_update_done": "Changed {name}",
        "status_delete_done": "Removed {name}",
        "err_unavailable": "The skill registry can't be reached",
        "err_user_required": "A user is needed",
        "err_name_required": "A skill needs a name",
        "err_not_found": "No such skill",
        "err_no_update_fields": "Nothing to change was given",
        "msg_created": "The skill was saved",
        "msg_updated": "The skill was changed",
        "msg_deleted": "The skill was removed",
        "msg_manual_enable_required": "The skill is saved but inactive; read it and activate it by hand",
    },
    "de-DE": {
        "status_listing": "Liste der Skills wird gelesen",
        "status_showing": "Skill wird gelesen",
        "status_creating": "Skill wird gespeichert",
        "status_updating": "Skill wird geändert",
        "status_deleting": "Skill wird entfernt",
        "status_list_done": "{count} Skills, davon {active_count} aktiv",
        "status_show_done": "{name} gelesen",
        "status_create_done": "{name} gespeichert",
        "status_create_overwrite_done": "{name} ersetzt",
        "status_update_done": "{name} geändert",
        "status_delete_done": "{name} entfernt",
        "err_unavailable": "Das Skill-Verzeichnis ist nicht erreichbar",
        "err_user_required": "Ein Benutzer wird benötigt",
        "err_name_required": "Ein Skill braucht einen Namen",
        "err_not_found": "Skill nicht gefunden",
        "err_no_update_fields": "Es wurde nichts zum Ändern angegeben",
        "msg_created": "Der Skill wurde gespeichert",
        "msg_updated": "Der Skill wurde geändert",
        "msg_deleted": "Der Skill wurde entfernt",
    },
    "fr-FR": {
        "status_listing": "Lecture de la liste des compétences",
        "status_showing": "Lecture de la compétence",
        "status_creating": "Sauvegarde de la compétence",
        "status_updating": "Changement de la compétence",
        "status_deleting": "Retrait de la compétence",
        "status_done": "Fini",
        "status_list_done": "{count} compétences, dont {active_count} actives",
        "status_show_done": "{name} lue",
        "status_create_done": "{name} sauvegardée",
        "status_create_overwrite_done": "{name} remplacée",
        "status_update_done": "{name} changée",
        "status_delete_done": "{name} retirée",
        "err_unavailable": "Le registre des compétences est injoignable",
        "err_user_required": "Il faut un utilisateur",
        "err_name_required": "Il faut un nom",
        "err_not_found": "Compétence introuvable",
        "err_no_update_fields": "Rien à changer n'a été indiqué",
        "msg_created": "La compétence a été sauvegardée",
        "msg_updated": "La compétence a été changée",
        "msg_deleted": "La compétence a été retirée",
    },
    "es-ES": {
        "status_listing": "Leyendo la lista de habilidades",
        "status_showing": "Leyendo la habilidad",
        "status_creating": "Guardando la habilidad",
        "status_updating": "Cambiando la habilidad",
        "status_deleting": "Quitando la habilidad",
        "status_done": "Terminado",
        "status_list_done": "{count} habilidades, {active_count} activas",
        "status_show_done": "{name} leída",
        "status_create_done": "{name} guardada",
        "status_create_overwrite_done": "{name} reemplazada",
        "status_update_done": "{name} cambiada",
        "status_delete_done": "{name} quitada",
        "err_unavailable": "No se puede acceder al registro de habilidades",
        "err_user_required": "Hace falta un usuario",
        "err_name_required": "Falta el nombre",
        "err_not_found": "No existe esa habilidad",
        "err_no_update_fields": "No se indicó nada que cambiar",
        "msg_created": "La habilidad se ha guardado",
        "msg_updated": "La habilidad se ha cambiado",
        "msg_deleted": "La habilidad se ha quitado",
    },
    "it-IT": {
        "status_listing": "Lettura dell'elenco delle competenze",
        "status_showing": "Lettura della competenza",
        "status_creating": "Salvataggio della competenza",
        "status_updating": "Cambiamento della competenza",
        "status_deleting": "Rimozione della competenza",
        "status_done": "Finito",
        "status_list_done": "{count} competenze, {active_count} attive",
        "status_show_done": "{name} letta",
        "status_create_done": "{name} salvata",
        "status_create_overwrite_done": "{name} sostituita",
        "status_update_done": "{name} cambiata",
        "status_delete_done": "{name} rimossa",
        "err_unavailable": "Il registro delle competenze non è raggiungibile",
        "err_user_required": "Serve un utente",
        "err_name_required": "Una competenza ha bisogno di un nome",
        "err_not_found": "Competenza non trovata",
        "err_no_update_fields": "Non è stato indicato nulla da cambiare",
        "msg_created": "La competenza è stata salvata",
        "msg_updated": "La competenza è stata cambiata",
        "msg_deleted": "La competenza è stata rimossa",
    },
    "zh-CN": {
        "status_listing": "正在读取技能清单",
        "status_showing": "正在读取技能",
        "status_creating": "正在保存技能",
        "status_updating": "正在修改技能",
        "status_deleting": "正在移除技能",
        "status_done": "已结束",
        "status_list_done": "共 {count} 个技能，{active_count} 个已启用",
        "status_show_done": "已读取 {name}",
        "status_create_done": "已保存 {name}",
        "status_create_overwrite_done": "已替换 {name}",
        "status_update_done": "已修改 {name}",
        "status_delete_done": "已移除 {name}",
        "err_unavailable": "无法连接技能库",
        "err_user_required": "需要有用户",
        "err_name_required": "技能需要名称",
        "err_not_found": "没有这个技能",
        "err_no_update_fields": "没有给出要修改的内容",
        "msg_created": "技能已保存",
        "msg_updated": "技能已修改",
        "msg_deleted": "技能已移除",
    },
    "zh-TW": {
        "status_listing": "正在讀取技能清單",
        "status_showing": "正在讀取技能",
        "status_creating": "正在儲存技能",
        "status_updating": "正在修改技能",
        "status_deleting": "正在移除技能",
        "status_done": "已結束",
        "status_list_done": "共 {count} 個技能，{active_count} 個已啟用",
        "status_show_done": "已讀取 {name}",
        "status_create_done": "已儲存 {name}",
        "status_create_overwrite_done": "已取代 {name}",
        "status_update_done": "已修改 {name}",
        "status_delete_done": "已移除 {name}",
        "err_unavailable": "無法連線到技能庫",
        "err_user_required": "需要有使用者",
        "err_name_required": "技能需要名稱",
        "err_not_found": "沒有這個技能",
        "err_no_update_fields": "沒有提供要修改的內容",
        "msg_created": "技能已儲存",
        "msg_updated": "技能已修改",
        "msg_deleted": "技能已移除",
    },
    "zh-HK": {
        "status_listing": "正在讀取技能清單",
        "status_showing": "正在讀取技能",
        "status_creating": "正在儲存技能",
        "status_updating": "正在更改技能",
        "status_deleting": "正在移除技能",
        "status_done": "已結束",
        "status_list_done": "共有 {count} 個技能，{active_count} 個已啟用",
        "status_show_done": "已讀取 {name}",
        "status_create_done": "已儲存 {name}",
        "status_create_overwrite_done": "已取代 {name}",
        "status_update_done": "已更改 {name}",
        "status_delete_done": "已移除 {name}",
        "err_unavailable": "連接唔到技能庫",
        "err_user_required": "需要有用戶",
        "err_name_required": "技能需要名稱",
        "err_not_found": "冇呢個技能",
        "err_no_update_fields": "冇提供要更改嘅內容",
        "msg_created": "技能已儲存",
        "msg_updated": "技能已更改",
        "msg_deleted": "技能已移除",
    },
    "ja-JP": {
        "status_listing": "スキルの一覧を読んでいます",
        "status_showing": "スキルを読んでいます",
        "status_creating": "スキルを保存しています",
        "status_updating": "スキルを変更しています",
        "status_deleting": "スキルを取り除いています",
        "status_done": "終わりました",
        "status_list_done": "スキル {count} 件、有効 {active_count} 件",
        "status_show_done": "{name} を読みました",
        "status_create_done": "{name} を保存しました",
        "status_create_overwrite_done": "{name} を置き換えました",
        "status_update_done": "{name} を変更しました",
        "status_delete_done": "{name} を取り除きました",
        "err_unavailable": "スキルの登録先に接続できません",
        "err_user_required": "ユーザーが必要です",
        "err_name_required": "スキルには名前が必要です",
        "err_not_found": "スキルがありません",
        "err_no_update_fields": "変更する内容がありません",
        "msg_created": "スキルは保存されました",
        "msg_updated": "スキルは変更されました",
        "msg_deleted": "スキルは取り除かれました",
    },
    "ko-KR": {
        "status_listing": "스킬 목록을 읽는 중",
        "status_showing": "스킬을 읽는 중",
        "status_creating": "스킬을 저장하는 중",
        "status_updating": "스킬을 바꾸는 중",
        "status_deleting": "스킬을 없애는 중",
        "status_done": "끝났습니다",
        "status_list_done": "스킬 {count}개, 활성 {active_count}개",
        "status_show_done": "{name} 읽음",
        "status_create_done": "{name} 저장됨",
        "status_create_overwrite_done": "{name} 교체됨",
        "status_update_done": "{name} 변경됨",
        "status_delete_done": "{name} 제거됨",
        "err_unavailable": "스킬 저장소에 연결할 수 없습니다",
        "err_user_required": "사용자가 필요합니다",
        "err_name_required": "스킬에는 이름이 필요합니다",
        "err_not_found": "스킬이 없습니다",
        "err_no_update_fields": "바꿀 내용이 없습니다",
        "msg_created": "스킬을 저장했습니다",
        "msg_updated": "스킬을 바꿨습니다",
        "msg_deleted": "스킬을 제거했습니다",
    },
    "vi-VN": {
        "status_listing": "Đang đọc danh sách kỹ năng",
        "status_showing": "Đang đọc kỹ năng",
        "status_creating": "Đang lưu kỹ năng",
        "status_updating": "Đang sửa kỹ năng",
        "status_deleting": "Đang gỡ kỹ năng",
        "status_done": "Đã xong",
        "status_list_done": "{count} kỹ năng, {active_count} đang bật",
        "status_show_done": "Đã đọc {name}",
        "status_create_done": "Đã lưu {name}",
        "status_create_overwrite_done": "Đã thay {name}",
        "status_update_done": "Đã sửa {name}",
        "status_delete_done": "Đã gỡ {name}",
        "err_unavailable": "Không kết nối được kho kỹ năng",
        "err_user_required": "Cần có người dùng",
        "err_name_required": "Kỹ năng cần có tên",
        "err_not_found": "Không có kỹ năng này",
        "err_no_update_fields": "Chưa nêu nội dung cần sửa",
        "msg_created": "Kỹ năng đã được lưu",
        "msg_updated": "Kỹ năng đã được sửa",
        "msg_deleted": "Kỹ năng đã được gỡ",
    },
    "id-ID": {
        "status_listing": "Membaca daftar keahlian",
        "status_showing": "Membaca keahlian",
        "status_creating": "Menyimpan keahlian",
        "status_updating": "Mengubah keahlian",
        "status_deleting": "Menghapus keahlian",
        "status_done": "Selesai",
        "status_list_done": "{count} keahlian, {active_count} aktif",
        "status_show_done": "{name} dibaca",
        "status_create_done": "{name} disimpan",
        "status_create_overwrite_done": "{name} diganti",
        "status_update_done": "{name} diubah",
        "status_delete_done": "{name} dihapus",
        "err_unavailable": "Daftar keahlian tidak dapat dijangkau",
        "err_user_required": "Pengguna diperlukan",
        "err_name_required": "Keahlian perlu nama",
        "err_not_found": "Keahlian tidak ada",
        "err_no_update_fields": "Tidak ada yang diminta untuk diubah",
        "msg_created": "Keahlian telah disimpan",
        "msg_updated": "Keahlian telah diubah",
        "msg_deleted": "Keahlian telah dihapus",
    },
}


def _map(d: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def resolve_locale(tag: Column) -> Column:
    """Blank: the default.  Else, with ``_`` as ``-``: a locale, a locale in other case, a fallback key,
    one in other case, the fallback of what is before the first ``-``, the default."""
    norm = F.replace(strip_py(tag), F.lit("_"), F.lit("-"))
    low = F.lower(norm)
    lower_fallback = _map({k.lower(): v for k, v in FALLBACKS.items()})
    known = F.coalesce(
        F.element_at(_map({v: v for v in LOCALES}), norm),
        F.element_at(_map({v.lower(): v for v in LOCALES}), low),
        F.element_at(_map(FALLBACKS), norm),
        F.element_at(lower_fallback, low),
        F.element_at(lower_fallback, F.lower(F.split_part(norm, F.lit("-"), F.lit(1)))),
        F.lit(DEFAULT),
    )
    return F.when(is_filled(tag), known).otherwise(F.lit(DEFAULT))


def said(tag: str | None, key: str, **values: object) -> str:
    """``message`` of one tag and key, in plain Python, for the driver."""
    norm = (tag or "").strip(WS_PY).replace("_", "-")
    low, fallbacks = norm.lower(), {k.lower(): v for k, v in FALLBACKS.items()}
    known = {v.lower(): v for v in LOCALES}
    own = known.get(low) or FALLBACKS.get(norm) or fallbacks.get(low) or fallbacks.get(low.split("-")[0]) or DEFAULT
    template = MESSAGES.get(own, {}).get(key) or MESSAGES[DEFAULT].get(key, key)
    if not set(re.findall(r"\{(\w+)\}", template, re.ASCII)) <= set(values):
        return template
    return re.sub(r"\{(\w+)\}", lambda m: str(values[m[1]]), template, flags=re.ASCII)


def message(tag: Column, key: Column, **values: Column) -> Column:
    """The template of the locale, else of the default locale, else the key; placeholders filled."""
    flat = {f"{lang}\n{k}": t for lang, texts in MESSAGES.items() for k, t in texts.items()}
    found = F.element_at(_map(flat), F.concat(resolve_locale(tag), F.lit("\n"), key))
    return fill(F.coalesce(found, F.element_at(_map(MESSAGES[DEFAULT]), key), key), values)


def catalogue(spark: SparkSession) -> DataFrame:
    """All messages as (locale, key, template); a fixed, small table."""
    return spark.createDataFrame([(lang, k, t) for lang, texts in MESSAGES.items() for k, t in texts.items()], "locale string, key string, template string")


def look_up(requests: DataFrame, table: DataFrame) -> DataFrame:
    """requests (locale, key ...) with ``text`` from a catalogue of any size, by two left joins."""
    asked = requests.withColumn("_locale", resolve_locale(F.col("locale")))
    own = table.select(F.col("locale").alias("_locale"), "key", F.col("template").alias("_own"))
    base = table.where(F.col("locale") == DEFAULT).select("key", F.col("template").alias("_base"))
    out = asked.join(own, ["_locale", "key"], "left").join(base, "key", "left")
    return out.withColumn("text", F.coalesce("_own", "_base", "key")).select(*requests.columns, "text")
