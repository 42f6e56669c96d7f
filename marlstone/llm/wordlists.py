"""Frequent function words of the languages the text operators know."""

COMMON_WORDS = {
    "de": "der die das und den von zu mit sich des auf ist nicht ein eine als auch dem im wie",
    "en": "the of and to in is that for it was on are as with by at from this be which",
    "es": "el los las del y en una con por para su al lo como se sin no más sobre que",
    "fr": "de la le les et des un une du que est pour dans qui par sur plus ne pas ce",
    "it": "il di che e per non si gli delle della sono dei alla nel più anche le una con da",
    "nl": "het een van dat op te zijn met voor niet aan er om bij door de en in is als",
    "pl": "w i z na do się nie że jest od przez oraz są jak dla przy po co to ich",
    "pt": "o a os as em do da não uma com dos no se na por mais para que ao foi",
    "ru": "и в не на что с по как из к о за от это для при его все же были",
}
