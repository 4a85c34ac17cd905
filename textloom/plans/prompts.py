"""Wordings to ask a language model with, filled by :func:`textloom.functions.text.fill`; a provider of one's own may use others."""

from __future__ import annotations

TEMPLATES = {
    "spelling": "Correct the spelling of the word in angle brackets. Language: {language}. Answer with the whole sentence.\nSentence: {text}\nCandidates: {candidates}",
    "grading": "Is this answer to the question meaningful, empty of meaning, or a refusal? One word.\nQuestion: {question}\nAnswer: {text}",
    "segmenting": "Split the answer into statements that each say one thing, in its own words, one a line.\nQuestion: {question}\nAnswer: {text}",
    "label": "Give a label of at most four words in {language} to this statement.\nStatement: {text}",
    "description": "Describe in one sentence in {language} what this statement says.\nStatement: {text}",
    "cluster_label": "These statements belong together. Name what they share in at most four words of {language}.\nStatements:\n{documents}",
    "concepts": "List the separate ideas in these cluster labels. For each idea give the numbers of the clusters that show it.\nLabels:\n{labels}",
    "assignment": "How sure is it, from 0 to 1, that cluster {cluster} is about {concept}? Answer with the number.\nCluster: {label}",
    "themes": "Group these concepts into a few themes, each with a name.\nConcepts:\n{concepts}",
    "refining": "Make these labels clear and distinct. Keep the numbers in front of them.\nLabels:\n{labels}",
    "topic": "Keywords of a topic: {keywords}\nSome of its documents:\n{documents}\nGive the topic a short label.",
    "caption": "Say in one sentence what these pictures, described below, have in common.\nDescriptions:\n{documents}",
}
