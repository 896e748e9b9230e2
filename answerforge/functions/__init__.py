"""answerforge.functions"""
